"""Word lists, lookup tables and thresholds, and a container to swap them.

Everything under the marked comments is a fixed value that results depend on.
Operators take a ``Lexicon`` so that a corpus in another domain or language can
bring its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: dimensions, core set, clusters, ranks --------------------
DIMENSIONS = (
    "Transparency",
    "Accountability",
    "Privacy",
    "Safety",
    "Human Autonomy",
    "Inclusivity",
    "Fairness",
    "Environmental Sustainability",
)
CORE_DIMENSIONS = ("Transparency", "Accountability", "Privacy", "Safety")
CLUSTERS = {
    "Transparency": 0,
    "Accountability": 0,
    "Privacy": 1,
    "Safety": 1,
    "Fairness": 2,
    "Inclusivity": 2,
    "Human Autonomy": 3,
    "Environmental Sustainability": 3,
}
MATURITY_STAGES = ("Ad Hoc", "Developing", "Defined", "Managed", "Optimized")
PRIORITIES = ("Critical", "High", "Medium", "Low")

# --- fixed values: dimension profiles (definition, then five aspects) -------
PROFILES = {
    "Transparency": (
        "The extent to which AI systems disclose information about their operations, data sources, "
        "decision-making processes, and limitations. This includes public reporting, documentation "
        "practices, explainability mechanisms, audit trail availability, and stakeholder access to "
        "meaningful information about how AI systems function.",
        "Public disclosure of AI system capabilities and limitations",
        "Explainability of individual AI decisions",
        "Documentation of training data and methodologies",
        "Audit trail and logging of AI system operations",
        "Stakeholder access to meaningful information about AI operations",
    ),
    "Accountability": (
        "The assignment and enforcement of responsibility for AI system outcomes. This includes legal "
        "liability frameworks, human oversight mechanisms, governance structures with clear ownership, "
        "redress and grievance procedures, audit requirements, and consequences for harms caused by AI "
        "systems.",
        "Legal liability for AI-caused harms",
        "Human oversight and governance structures",
        "Grievance and redress mechanisms for affected individuals",
        "Audit and independent review of AI systems",
        "Assignment of responsibility for AI system outcomes",
    ),
    "Privacy": (
        "The protection of personal data and individual autonomy over information in AI systems. This "
        "includes data minimization, consent mechanisms, anonymization practices, data security, purpose "
        "limitation, data subject rights, and compliance with regulatory frameworks for data protection.",
        "Consent mechanisms for personal data collection",
        "Data minimization and purpose limitation",
        "Anonymization and pseudonymization practices",
        "Individual rights over personal data",
        "Data security and breach notification procedures",
    ),
    "Safety": (
        "The assurance that AI systems operate reliably and without causing unintended harm under all "
        "expected conditions. This includes robustness testing, fail-safe mechanisms, adversarial "
        "resistance, system monitoring, incident reporting, emergency shut-off capabilities, and "
        "pre-deployment certification processes.",
        "Robustness testing and validation of AI systems",
        "Adversarial resistance and security measures",
        "Fail-safe and emergency shut-off mechanisms",
        "Continuous monitoring and performance assurance",
        "Incident reporting and response procedures",
    ),
    "Human Autonomy": (
        "The preservation of human agency and self-determination in the presence of AI systems. This "
        "includes meaningful human control, opt-out mechanisms, human-in-the-loop requirements, the right "
        "to non-automated decision-making, and protections against undue manipulation or nudging by AI "
        "systems.",
        "Meaningful human control over AI decisions",
        "Opt-out mechanisms from automated decision-making",
        "Human-in-the-loop requirements for critical decisions",
        "Protection against manipulation and undue influence",
        "Right to non-automated decision-making",
    ),
    "Inclusivity": (
        "The active engagement of diverse stakeholders in AI system governance and the equitable "
        "distribution of AI benefits across society. This includes public participation mechanisms, "
        "multi-stakeholder governance, digital divide considerations, accessibility for persons with "
        "disabilities, linguistic diversity, and cultural representation.",
        "Multi-stakeholder participation in AI governance",
        "Digital divide and access inequality considerations",
        "Accessibility for persons with disabilities",
        "Cultural and linguistic diversity in AI design",
        "Equitable distribution of AI benefits",
    ),
    "Fairness": (
        "The absence of bias and equitable treatment across all population groups in AI system design, "
        "development, deployment, and outcomes. This includes bias testing and mitigation, demographic "
        "parity considerations, accessibility provisions, inclusive design practices, and protection "
        "against discrimination based on protected characteristics.",
        "Bias detection and mitigation in AI systems",
        "Equitable access to AI benefits and services",
        "Protection against algorithmic discrimination",
        "Inclusive design and accessibility",
        "Demographic fairness in AI training data",
    ),
    "Environmental Sustainability": (
        "The consideration and minimization of environmental impacts throughout the AI lifecycle. This "
        "includes energy efficiency, carbon footprint reporting, hardware lifecycle management, "
        "computational resource optimization, and alignment with environmental protection goals.",
        "Energy efficiency of AI training and inference",
        "Carbon footprint reporting and reduction targets",
        "Computational resource optimization",
        "Hardware lifecycle and e-waste management",
        "Alignment with environmental sustainability goals",
    ),
}
OVERVIEW_TOPICS = (
    "policy objectives, priorities, and overarching vision",
    "sector applications and use cases of AI",
    "target populations and beneficiaries",
    "implementation approach and institutional arrangements",
    "funding, investment, and resource allocation",
    "principles, values, and ethical commitments",
    "research, innovation, and capacity building",
    "international cooperation and partnerships",
)

# --- fixed values: topic stems per dimension --------------------------------
TOPIC_STEMS = {
    "Transparency": (
        "transparen", "disclos", "explainab", "documentation", "audit trail", "logging", "open",
        "public report", "inform", "opacity", "opaque", "black box", "decision-making", "interpretab",
    ),
    "Accountability": (
        "accountab", "liabilit", "redress", "grievance", "complaint", "oversight", "audit", "enforce",
        "enforcement", "responsib", "sanction", "penalty", "remedy", "remedies", "answerable", "blame",
        "consequence", "governance structure", "ownership", "obligation", "duty",
    ),
    "Privacy": (
        "privacy", "personal data", "consent", "anonymiz", "pseudonymiz", "data protection",
        "data minimiz", "purpose limitation", "data subject", "breach", "confidential", "data security",
    ),
    "Safety": (
        "safety", "safe", "robust", "fail-safe", "failsafe", "adversarial", "monitor", "monitoring",
        "incident", "emergency", "shut-off", "certification", "harm", "reliability", "test", "testing",
        "validation", "red team",
    ),
    "Human Autonomy": (
        "autonomy", "human control", "human oversight", "opt-out", "human-in-the-loop",
        "human in the loop", "self-determination", "non-automated", "manipulation", "nudge", "nudging",
        "human agency", "override", "meaningful control",
    ),
    "Inclusivity": (
        "inclusiv", "inclusion", "accessib", "digital divide", "multi-stakeholder", "multistakeholder",
        "public participation", "diversity", "diverse", "disabilit", "linguistic", "cultural",
        "represent", "underserved", "marginalis", "equitab", "equity", "non-discriminat", "gender",
        "persons with disabilities",
    ),
    "Fairness": (
        "fair", "fairness", "bias", "discrimina", "equitab", "demographic parity",
        "protected characteristics", "prejudice", "stereotype", "parity",
    ),
    "Environmental Sustainability": (
        "environment", "environmental", "sustainab", "energy efficiency", "carbon", "footprint",
        "climate", "lifecycle", "e-waste", "emissions", "green", "computational resource",
        "resource consumption", "energy consumption",
    ),
}

# --- fixed values: mechanism and commitment vocabulary ----------------------
NAMED_BODY = (
    "commission", "board", "authority", "ministry", "agency", "council", "task force", "committee",
    "directorate", "office", "institute", "centre", "center", "department", "ombudsman",
    "inspectorate", "agencies", "ministries", "authorities", "ombudsmen",
)
REPORTING = (
    "report", "reporting", "reported", "register", "registered", "registry", "registries",
    "publication", "annual report", "disclosure", "transparency report", "publish", "published",
    "publishing", "notify", "records", "documentation requirement", "audit trail",
)
ENFORCEMENT = (
    "enforce", "enforcement", "enforcing", "redress", "grievance", "complaint", "appeal", "sanction",
    "penalty", "penalties", "fine", "remedy", "remedies", "liability", "liabilities", "audit",
    "auditing", "inspect", "inspecting", "inspection", "inspections", "monitor", "monitoring",
    "oversight", "supervision", "compliance check", "corrective action", "revocation", "order to stop",
)
STRONG_COMMITMENT = (
    "will establish", "shall establish", "will set up", "shall set up", "setting up",
    "establishment of", "establish a", "establish an", "establish the", "will create", "shall create",
    "will launch", "shall launch", "will develop", "shall develop", "will implement",
    "shall implement", "will invest", "shall invest", "to establish", "to set up", "to create",
    "to launch", "to develop", "roadmap", "action plan", "program", "programme", "initiative",
    "mission", "task force", "pledge", "mandatory",
)
WEAK_COMMITMENT = (
    "commitment", "mandate", "mandated", "dedicated", "allocate", "allocation", "budget",
)
COMMITMENT_VERBS = (
    "commits to", "committed to", "pledge", "pledges", "pledged", "plans to", "intends to",
    "will ensure", "working towards", "aims to", "seeks to", "will address", "will promote",
    "will support",
)
NEGATORS = (
    "not", "no", "never", "unable", "fails", "failed", "won't", "doesn't", "cannot", "can't",
    "isn't", "aren't", "without", "lacks", "refuses", "declines", "against",
)
NEGATION_WINDOW = 16

# --- fixed values: boilerplate, stop words, sentinels -----------------------
PREAMBLE_MARKERS = (
    "intentionally left blank", "acknowledgment", "acknowledgement", "table of contents", "contents",
    "copyright", "all rights reserved",
)
QUERY_STOP_WORDS = (
    "the", "and", "for", "are", "was", "has", "had", "but", "not", "its", "can", "all", "any",
    "each", "their", "that", "this", "with", "from", "have", "been", "would", "could", "should",
    "about", "which", "than", "into", "over", "such", "also",
)
ENGLISH_STOP_WORDS = (
    "the", "a", "an", "and", "of", "to", "in", "for", "on", "with", "is", "are", "that", "this",
    "these", "those", "as", "at", "by", "from", "or", "be", "it", "its", "not", "but", "which",
    "will", "can", "their", "has", "have", "had", "was", "were", "about",
)
FOREIGN_STOP_WORDS = {
    "fr": (
        "le", "la", "les", "un", "une", "des", "et", "en", "au", "aux", "du", "de", "ce", "cette",
        "ces", "sur", "pour", "par", "dans", "avec", "est", "sont", "que", "qui", "plus", "pas",
        "nous", "vous", "ils", "elles", "à", "l'ia", "d'une", "d'un",
    ),
    "es": (
        "el", "la", "los", "las", "un", "una", "unos", "unas", "de", "del", "y", "en", "con", "por",
        "para", "que", "es", "son", "se", "su", "sus", "como", "más", "pero",
    ),
    "de": (
        "der", "die", "das", "den", "dem", "des", "ein", "eine", "einer", "eines", "und", "oder",
        "mit", "von", "für", "ist", "sind", "auf", "zu", "nicht", "auch", "als", "im", "in",
    ),
    "it": (
        "il", "lo", "la", "i", "gli", "le", "un", "una", "di", "del", "e", "con", "per", "che", "è",
        "sono", "su", "da", "non",
    ),
}
NO_CITATION_SENTINELS = (
    "insufficient evidence for citation", "insufficient evidence", "no citation available",
    "no citation", "no supporting passage", "not available", "none", "n/a", "na",
)
DOCUMENT_QUESTION_MARKERS = (
    "this document", "the document", "this policy", "the policy", "this strategy", "the strategy",
    "this report", "the report", "summarize", "summarise", "overview", "main focus", "focus on",
    "what does the policy", "what does this", "what is in the", "approach to", "key themes",
    "main themes", "priorities of", "what are the main", "about the document", "tell me about this",
)
PAIR_NEGATIONS = (
    "not", "no", "never", "nor", "neither", "cannot", "can't", "don't", "doesn't", "didn't", "won't",
    "wouldn't", "shouldn't", "isn't", "aren't", "wasn't", "weren't", "hasn't", "haven't", "does not",
    "do not", "will not", "shall not", "must not", "absence", "lack", "without", "fails to",
    "failure to",
)

# --- fixed values: drift vocabulary -----------------------------------------
DRIFT_STRONG = (
    "should implement", "should establish", "should adopt", "should create", "should introduce",
    "should develop", "should require", "would strengthen", "would translate", "would close",
    "would address", "will strengthen", "will translate", "recommend that", "it is recommended",
    "we recommend", "in order to", "bridge the gap", "close the gap", "needs to",
    "does not substantively",
)
DRIFT_SOFT_WORDS = (
    "should", "would", "recommend", "lacks", "missing", "gap", "shortfall", "deficit",
)
DRIFT_SOFT_PHRASES = ("does not", "not substantively", "fails to", "insufficient", "no provisions")
DRIFT_DOWNGRADE_AT = 3

# --- fixed values: dimension graph and subset rule --------------------------
GRAPH_EDGES = (
    ("Governance", "Accountability", "subsumes"),
    ("Accountability", "Human Oversight", "requires"),
    ("Human Oversight", "Transparency", "requires"),
    ("Transparency", "Explainability", "subsumes"),
    ("Explainability", "Auditability", "requires"),
    ("Risk Management", "Impact Assessment", "subsumes"),
    ("Risk Management", "Safety", "requires"),
    ("Safety", "Robustness", "subsumes"),
    ("Privacy", "Data Protection", "subsumes"),
    ("Data Protection", "Anonymization", "requires"),
    ("Fairness", "Non-discrimination", "subsumes"),
    ("Inclusivity", "Accessibility", "subsumes"),
    ("Inclusivity", "Equity", "requires"),
    ("Accountability", "Liability", "subsumes"),
    ("Ethics", "Human Rights", "subsumes"),
    ("Ethics", "Inclusivity", "requires"),
    ("Governance", "Risk Management", "requires"),
)
SUBSET_EDGES = (
    ("Transparency", "Explainability"),
    ("Privacy", "Data Protection"),
    ("Privacy", "Anonymization"),
    ("Inclusivity", "Accessibility"),
    ("Inclusivity", "Non-discrimination"),
    ("Risk Management", "Safety"),
    ("Risk Management", "Impact Assessment"),
    ("Accountability", "Liability"),
    ("Accountability", "Oversight"),
    ("Fairness", "Non-discrimination"),
)

# --- fixed values: agency vocabulary ----------------------------------------
AGENCY_SKIP_WORDS = (
    "the", "and", "ai", "india", "task", "phase", "step", "such", "in", "of", "to", "a", "an",
    "data", "public", "national", "new", "this", "standard", "standards", "body", "bodies", "each",
    "for", "with", "across", "government", "all", "high", "risk", "use", "using", "ml",
)
AGENCY_DESIGNATORS = (
    "ministry", "department", "bureau", "board", "authority", "commission", "agency", "institute",
    "council", "office", "foundation", "centre", "center", "directorate", "secretariat", "committee",
    "division", "cell", "administration", "regulator", "parliament", "cabinet", "task force",
)
NO_AGENCY_TEXT = (
    "Not specified by policy — implementation responsibility should be assigned by the adopting "
    "government."
)

# --- fixed values: routing --------------------------------------------------
CORE_FRAMEWORKS = (
    "UNESCO Recommendation on the Ethics of AI",
    "OECD AI Principles",
    "UNDP Digital Strategy 2022-2025",
    "UN Global Digital Compact",
    "UN Roadmap for Digital Cooperation",
    "EU AI Act (Regulation (EU) 2024/1689)",
    "NIST AI Risk Management Framework 1.0",
)
REGION_COUNTRIES = {
    "ASEAN": (
        "brunei", "brunei darussalam", "cambodia", "indonesia", "laos", "lao pdr",
        "lao people's democratic republic", "malaysia", "myanmar", "philippines", "singapore",
        "thailand", "vietnam", "viet nam", "timor-leste", "timor leste",
    ),
    "AU": (
        "algeria", "angola", "benin", "botswana", "burkina faso", "burundi", "cabo verde",
        "cape verde", "cameroon", "central african republic", "chad", "comoros", "congo",
        "republic of the congo", "democratic republic of the congo", "drc", "côte d'ivoire",
        "cote d'ivoire", "ivory coast", "djibouti", "egypt", "equatorial guinea", "eritrea",
        "eswatini", "swaziland", "ethiopia", "gabon", "gambia", "ghana", "guinea", "guinea-bissau",
        "kenya", "lesotho", "liberia", "libya", "madagascar", "malawi", "mali", "mauritania",
        "mauritius", "morocco", "mozambique", "namibia", "niger", "nigeria", "rwanda",
        "são tomé and príncipe", "sao tome and principe", "senegal", "seychelles", "sierra leone",
        "somalia", "south africa", "south sudan", "sudan", "tanzania", "togo", "tunisia", "uganda",
        "zambia", "zimbabwe",
    ),
}

# --- fixed values: roles of frameworks ---------------------------------------
NORMATIVE = "module_1_normative"
PRACTICAL = "module_2_practical"
IMPLEMENTATION = "module_3_implementation"
INCIDENT = "module_4_incident"

# --- fixed values: document type rules, in order ----------------------------
DOCUMENT_TYPE_RULES = (
    ("strategy", ("strategy", "national ai strategy", "action plan", "roadmap")),
    ("legislation", ("regulation", "regulatory", "act ", "legislation")),
    ("code_of_conduct", ("code of conduct", "ethics", "ethical")),
    ("standard", ("technical", "guideline", "standard")),
    ("standard", ("framework",)),
)


@dataclass(frozen=True)
class Lexicon:
    """The vocabularies the rules read; replace any of them per corpus."""

    topics: dict = field(default_factory=lambda: dict(TOPIC_STEMS))
    named_body: tuple = NAMED_BODY
    reporting: tuple = REPORTING
    enforcement: tuple = ENFORCEMENT
    strong: tuple = STRONG_COMMITMENT
    weak: tuple = WEAK_COMMITMENT
    verbs: tuple = COMMITMENT_VERBS
    negators: tuple = NEGATORS
    drift_strong: tuple = DRIFT_STRONG
    drift_soft_words: tuple = DRIFT_SOFT_WORDS
    drift_soft_phrases: tuple = DRIFT_SOFT_PHRASES
    document_types: tuple = DOCUMENT_TYPE_RULES


DEFAULT = Lexicon()
