"""Default rule values. Every operator takes its rules as a parameter; these are the usual ones."""

from __future__ import annotations

# Words that carry no subject. They are tested on stems, so a word whose stem differs survives.
STOPWORDS = [
    "a", "an", "and", "any", "are", "as", "at", "be", "been", "being", "but", "by", "can", "do", "does", "each", "for", "from", "had", "has", "have",
    "if", "in", "into", "is", "it", "its", "may", "must", "not", "of", "on", "only", "or", "other", "shall", "should", "such", "than", "that", "the",
    "their", "then", "there", "these", "this", "those", "to", "was", "were", "when", "where", "which", "will", "with", "would", "how", "what", "who",
    "whom", "whose", "why", "quickly", "soon", "long", "many", "much", "need", "needs",
]

# Words whose -ise ending is no suffix.
KEEP_ISE = [
    "advise", "advertise", "arise", "chastise", "circumcise", "comprise", "compromise", "concise", "demise", "despise", "devise", "disguise",
    "excise", "exercise", "franchise", "improvise", "incise", "merchandise", "otherwise", "precise", "premise", "promise", "revise", "rise",
    "supervise", "surmise", "surprise", "televise", "wise",
]

# Spellings that no suffix rule covers.
SPELLINGS = {
    "analyse": "analyze", "analysed": "analyzed", "analyses": "analyzes", "analysing": "analyzing", "analyser": "analyzer",
    "paralyse": "paralyze", "catalogue": "catalog", "dialogue": "dialog", "licence": "license", "licenced": "licensed",
    "licencing": "licensing", "defence": "defense", "offence": "offense", "practise": "practice", "centre": "center",
    "centres": "centers", "metre": "meter", "fibre": "fiber", "programme": "program", "programmes": "programs",
    "behaviour": "behavior", "behavioural": "behavioral", "colour": "color", "favour": "favor", "labour": "labor",
    "neighbour": "neighbor", "organisation": "organization", "organisational": "organizational", "authorise": "authorize",
    "authorised": "authorized", "authorisation": "authorization", "utilise": "utilize", "utilised": "utilized", "enrol": "enroll",
    "enrolment": "enrollment", "fulfil": "fulfill", "fulfilment": "fulfillment", "judgement": "judgment",
    "acknowledgement": "acknowledgment", "storey": "story", "grey": "gray",
}

# Suffixes folded to one spelling, in order.
ISE_SUFFIXES = [("isation", "ization"), ("isations", "izations"), ("ising", "izing"), ("ised", "ized"), ("iser", "izer"), ("isers", "izers"), ("ises", "izes"), ("ise", "ize")]
IZ_SUFFIXES = ["izational", "izations", "ization", "izing", "izers", "izer", "izes", "ized", "ize"]

# Scoring constants of topical search.
K1, B = 1.2, 0.75
TF_BODY, TF_TITLE, TF_SECTION = 1.0, 2.0, 0.8
FLOOR, RELATIVE_FLOOR = 0.12, 0.25
ALL_TERMS, PHRASE, STRUCTURAL = 0.12, 0.20, 0.15
CONCEPT, SOLO, MAX_TERMS, LEAD = 0.8, 0.7, 24, 5
TIER_NUDGE = {1: 0.06, 2: 0.05, 3: 0.03, 4: 0.02, 5: 0.0}

# Quantities. Hours of a unit; months and years by convention.
EXACT_HOURS = {"second": 1 / 3600, "minute": 1 / 60, "hour": 1.0, "day": 24.0, "week": 168.0}
CALENDAR_HOURS = {"month": 720.0, "year": 8760.0}
WORD_NUMBERS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11,
    "twelve": 12, "fifteen": 15, "twenty": 20, "twenty-four": 24, "thirty": 30, "sixty": 60, "ninety": 90,
}

# Phrases that bound the number after them: (phrase, bound, whether it carries its own negation).
BOUNDS = [
    ("at regular intervals no more than", "at most", True), ("not set to greater than", "at most", True), ("no greater than", "at most", True),
    ("not longer than", "at most", True), ("no later than", "at most", True), ("not later than", "at most", True), ("must not exceed", "at most", True),
    ("not more than", "at most", True), ("no more than", "at most", True), ("no less than", "at least", True), ("not less than", "at least", True),
    ("less than", "at most", False), ("shorter than", "at most", False), ("a maximum of", "at most", False), ("maximum of", "at most", False),
    ("up to", "at most", False), ("within", "at most", False), ("after", "at most", False), ("≤", "at most", False), ("<=", "at most", False),
    ("<", "at most", False), ("at least every", "at least", False), ("a minimum of", "at least", False), ("minimum of", "at least", False),
    ("greater than", "at least", False), ("longer than", "at least", False), ("more than", "at least", False), ("at least", "at least", False),
    ("exceeds", "at least", False), ("≥", "at least", False), (">=", "at least", False), (">", "at least", False), ("of", "unstated", False),
]
CADENCE = ["at least every", "at regular intervals no more than", "every"]
NEGATIONS = ["must not", "shall not", "may not", "is not", "are not", "not set to", "cannot", "never"]
LOOSE_BOUNDS = [("maximum", "at most"), ("no more than", "at most"), ("must not exceed", "at most"), ("minimum", "at least"), ("at least", "at least")]
STATUS_WORDS = ["disallowed", "deprecated", "legacy use", "acceptable", "approval status", "restricted", "no longer approved"]

# A number per unit of time is a rate; where a clause ends.
RATE = r"(?i)^\s*(per|every|a|each)\s+(hour|day|week|month|year)\b"
CLAUSE_BREAKS = r"\. |; |: | - | • | — "

# Who can be asked to do something, and what refuses a derivation: (reason, part, letters read, pattern, lifted by, letters read for that).
ACTOR = r"(?i)\b(entity|entities|organisation|organization|agency|agencies|responsible entity|system owner|personnel|users?|supplier|service provider)\b"
DEFINITION = r"(?i)^\s*(meaning of|definitions?|interpretation|simplified outline|application of (?:this|the)|object(?:s)? of (?:this|the))\b"
REFUSED_ABOVE = r"(?i)^\s*(definitions?|interpretation|preliminary|meaning of|dictionary|simplified outline)\b"
SHORTEST_TEXT = 12
REFUSALS = [
    ("definition", "title", None, DEFINITION, None, None),
    ("definition", "text", None, DEFINITION, None, None),
    ("definition", "text", 240, r"\b(means|has the same meaning as|is taken to be)\b", ACTOR, 240),
    ("penalty", "both", None, r"(?i)\b(civil penalty|penalty units|is guilty of an offence)\b", ACTOR, 200),
    ("power of an office holder", "text", 220, r"\b(the Minister|the Secretary|the Prime Minister|the Commissioner|the Inspector-General|the Department)\b", ACTOR, 220),
]

# Usual rules of what may not be released, in order: (reason, pattern of the path).
WITHHELD = [("folder", "^(sources|cache|private)/"), ("suffix", r"\.(pdf|docx|xlsx|zip)$"), ("name", "(?i)secret|credential")]
