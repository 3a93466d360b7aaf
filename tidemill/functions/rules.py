"""Rule tables of the postings engine, as plain data."""

from __future__ import annotations

#: Terms a posting's title must hold one of.
TITLE_TERMS = [
    "QA Engineer", "QA Automation Engineer", "Test Automation Engineer", "Software Test Engineer", "Software Engineer in Test", "SDET",
    "Quality Engineer", "Software Quality Assurance Engineer", "Backend QA Engineer", "Test Engineer", "QA Ingenieur",
    "QA-Automatisierungsingenieur", "Testautomatisierungsingenieur", "Softwaretestingenieur", "Software-Testingenieur", "Qualitätsingenieur",
    "Qualitätssicherungsingenieur", "Softwaretester", "Testautomatisierer", "Testingenieur",
]

#: The city scope, placeholders for a missing location, the remote scope and its negations.
CITY = r"münchen|munich|muenchen"
PLACEHOLDERS = ["", "germany", "deutschland"]
REMOTE_LOCATION = r"remote"
REMOTE_PHRASE = r"100\s*%\s*remote|full(?:y)?[\s-]*remote|vollständig\s+remote|komplett\s+remote|remote\s+only"
NEGATION = r"\bnot\b|\bnicht\b|\bkeine?\b|\bno\s+longer\b"
CLAUSE_ENDS = ".;<"
NEGATION_WINDOW, DISCLAIMER_WINDOW = 30, 60

#: Statements that a role requires German.
GERMAN_REQUIRED = [
    r"deutsch\w*[^;<]{0,40}\b(b1|b2|c1|c2)\b",
    r"german\w*[^;<]{0,40}\b(b1|b2|c1|c2)\b",
    r"(fließend\w*|verhandlungssicher\w*)[^.;<]{0,40}deutsch\w*",
    r"deutsch\w*[^.;<]{0,40}(fließend\w*|verhandlungssicher\w*)",
    r"\bfluen\w*[^.;<]{0,20}german",
    r"native\w*[^.;<]{0,20}german",
    r"deutsch\w*[^.;<]{0,20}mutterspr\w*",
    r"mutterspr\w*[^.;<]{0,20}deutsch\w*",
    r"gute[srn]?\s+deutsch\w*",
    r"deutschkenntnisse\s*\(?\s*erforderlich",
    r"(?:very\s+)?(?:good|excellent|strong|solid)\w*[^.;<]{0,25}(?:knowledge|skills?|proficiency|command)\w*[^.;<]{0,15}german\w*",
    r"german\w*[^.;<]{0,25}skills?\b",
]
#: What makes such a statement optional, and what turns that on English instead.
DISCLAIMERS = [
    r"von\s+vorteil", r"wünschenswert", r"ein\s+plus", r"kein\s+muss", r"optional", r"a\s+plus", r"nice[\s-]to[\s-]have", r"desirable",
    r"not\s+required", r"not\s+mandatory",
]
ENGLISH_MENTION = r"english|englisch"

#: Function words that tell German from English prose. The word "on" is not counted.
GERMAN_WORDS = [
    "der", "die", "das", "und", "mit", "für", "ist", "sich", "eine", "einen", "einer", "werden", "wir", "auf", "von", "nicht", "oder", "auch",
    "sind", "du", "deine", "dein", "unser", "unsere", "zur", "zum", "dich", "im", "am", "als", "bei", "des", "dem", "den", "ein", "aus", "nach",
    "über", "durch", "kannst", "hast", "haben", "hat", "können", "dieser", "diese", "dieses", "dir", "deinen", "deiner", "uns", "euch", "wird",
    "zu",
]
ENGLISH_WORDS = [
    "the", "and", "with", "for", "is", "are", "you", "your", "we", "our", "this", "that", "will", "from", "have", "has", "of", "to", "in", "as",
    "be", "or", "an", "by", "about", "team", "work", "company", "join", "who", "what", "when", "where", "why", "how", "if",
]
#: From how many German words, and from which share of both languages' words, prose is German.
MIN_GERMAN_WORDS, MIN_GERMAN_RATIO = 15, 0.6

#: Place names for and against a location in Germany.
IN_GERMANY = (
    r"germany|deutschland|münchen|munich|muenchen|berlin|hamburg|frankfurt|k[öo]ln|cologne|stuttgart|d[üu]sseldorf|leipzig|dresden|"
    r"n[üu]rnberg|nuremberg|hannover|bremen|essen|dortmund|bonn|mannheim|karlsruhe|augsburg|wiesbaden|m[üu]nster|freiburg|erlangen|"
    r"heidelberg|potsdam|regensburg|w[üu]rzburg|bielefeld"
)
ABROAD = (
    r"\b(usa|united states|u\.s\.|uk|united kingdom|austria|switzerland|spain|france|italy|poland|netherlands|portugal|india|canada|"
    r"australia|ireland|sweden|denmark|belgium|barcelona|madrid|paris|milan|rome|vienna|zurich|london|amsterdam|dublin|warsaw|lisbon|"
    r"stockholm|copenhagen|brussels)\b"
)

#: Vendors and the patterns, tried in order, whose groups are a company's identifier there.
SIGNATURES = [
    ("greenhouse", [r"boards\.greenhouse\.io/embed/job_board[^\"'\s]*[?&]for=([a-z0-9_-]+)", r"boards-api\.greenhouse\.io/v1/boards/([a-z0-9_-]+)", r"boards\.greenhouse\.io/([a-z0-9_-]+)", r"job-boards(?:\.\w+)?\.greenhouse\.io/([a-z0-9_-]+)"]),
    ("lever", [r"jobs\.lever\.co/([a-z0-9_-]+)"]),
    ("ashby", [r"jobs\.ashbyhq\.com/([a-z0-9_-]+)"]),
    ("smartrecruiters", [r"jobs\.smartrecruiters\.com/([a-z0-9_-]+)", r"api\.smartrecruiters\.com/v1/companies/([a-z0-9_-]+)"]),
    ("personio", [r"([a-z0-9-]+)\.jobs\.personio\.(?:de|com)"]),
    ("workday", [r"([a-z0-9-]+)\.(wd\d+)\.myworkdayjobs\.com/([a-z0-9_-]+)"]),
    ("softgarden", [r"([a-z0-9-]+)\.(?:career\.)?softgarden\.(?:io|de)"]),
    ("workable", [r"apply\.workable\.com/([a-z0-9_-]+)"]),
    ("recruitee", [r"([a-z0-9-]+)\.recruitee\.com"]),
    ("teamtailor", [r"([a-z0-9-]+)\.teamtailor\.com"]),
    ("join", [r"join\.com/companies/([a-z0-9-]+)"]),
    ("rexx", [r"rexx-systems\.com"]),
    ("onlyfy", [r"([a-z0-9-]+)\.onlyfy\.jobs"]),
    ("dvinci", [r"d-vinci\.de"]),
    ("bamboohr", [r"([a-z0-9-]+)\.bamboohr\.com"]),
    ("jazzhr", [r"jazzhr\.com"]),
]
#: Attributes of embedded boards whose value is an identifier.
DATA_ATTRIBUTES = [
    ("greenhouse", r"data-board-token=[\"']([a-z0-9_-]+)[\"']"),
    ("personio", r"data-personio-(?:id|client)=[\"']([a-z0-9_-]+)[\"']"),
    ("softgarden", r"data-softgarden-id=[\"']([a-z0-9_-]+)[\"']"),
]
#: Where career pages are, and how links to them and to their listings read.
CAREER_PATHS = ["/careers", "/career", "/jobs", "/en/careers", "/en/jobs", "/karriere", "/de/karriere", "/join-us"]
CAREER_LINK = r"career|karriere|jobs?\b|stellenangebote|stellenanzeigen|wir suchen|join us"
LISTING_LINK = (
    r"open\s*(?:role|position|vacanc\w*)s?|current\s*openings?|job\s*openings?|view\s*(?:all\s*)?jobs|"
    r"see\s*(?:all\s*)?(?:our\s*)?(?:jobs|roles)|offene\s*stellen|alle\s*stellen"
)
#: Host labels that are no company's name, and vendors without identifiers.
NOISE_LABELS = ["www", "de", "en", "eu", "careers", "jobs", "m"]
NO_SLUG_VENDORS = ["rexx", "dvinci", "jazzhr"]
#: The text of a report of nothing, and the most characters of a message.
EMPTY_REPORT = "No new QA jobs today."
MESSAGE_LIMIT = 4096
