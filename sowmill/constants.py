"""Word lists, tables, patterns and thresholds of the domain.

Everything in this module is data that results depend on; the order of the
entries matters wherever a rule says "first match wins".
"""

from __future__ import annotations

# --- fixed values: units and thresholds --------------------------------------
YEAR_HOURS = 1800.0
WEEK_HOURS = 40.0
DAYS_PER_MONTH = 30.44
DAYS_PER_WEEK = 7
WEEKS_PER_MONTH = 4
DEFAULT_WEEKS = 26
FULL_TEXT_WEIGHT, PARSED_WEIGHT = 0.6, 0.4
VECTOR_WEIGHT, TEXT_WEIGHT = 0.7, 0.3
MIN_BLENDED_SCORE, MIN_VECTOR_SCORE = 0.01, 0.3
FUZZY_RATIO = 0.8
CONFIDENCE_BANDS = [("high", 0.8), ("medium", 0.6), ("low", 0.4)]
MAX_TEAM_SIZE = 50
MAX_DELIVERABLE_CHARS = 500
MISSING_WORDS = ["", "N/A", "NA"]

# --- fixed values: departments ------------------------------------------------
CLIENT_SERVICES = "client_services"
STRATEGY = "strategy"
PLANNING_CREATIVE = "planning_creative"
PRODUCTION = "integrated_production_experiences"
DEPARTMENTS = [CLIENT_SERVICES, STRATEGY, PLANNING_CREATIVE, PRODUCTION]
DEPARTMENT_LABELS = {
    CLIENT_SERVICES: "Client Services (Account Management, Client Relationships)",
    STRATEGY: "Strategy (Strategic Planning, Insights, Analytics)",
    PLANNING_CREATIVE: "Planning & Creative (Creative Development, Brand Work, Campaign Planning)",
    PRODUCTION: "Integrated Production & Experiences (Events, Hospitality, Activations, Production)",
}

# --- fixed values: role map, in match order -----------------------------------
ROLE_MAP = [
    ("account director", "account_director", CLIENT_SERVICES, 5),
    ("account manager", "account_manager", CLIENT_SERVICES, 3),
    ("sr. account manager", "sr_account_manager", CLIENT_SERVICES, 4),
    ("sr account manager", "sr_account_manager", CLIENT_SERVICES, 4),
    ("account executive", "account_executive", CLIENT_SERVICES, 1),
    ("ae", "account_executive", CLIENT_SERVICES, 1),
    ("sr. account executive", "sr_account_executive", CLIENT_SERVICES, 2),
    ("sae", "sr_account_executive", CLIENT_SERVICES, 2),
    ("account trainee", "account_trainee", CLIENT_SERVICES, 1),
    ("vice president", "vice_president", CLIENT_SERVICES, 7),
    ("vp", "vice_president", CLIENT_SERVICES, 7),
    ("group director", "group_director", CLIENT_SERVICES, 6),
    ("strategy director", "director_sponsorship_strategy", STRATEGY, 5),
    ("strategist", "planner_sponsorship_strategy", STRATEGY, 2),
    ("planner", "planner_sponsorship_strategy", STRATEGY, 2),
    ("sponsorship strategist", "director_sponsorship_strategy", STRATEGY, 5),
    ("analyst", "analyst_digital_media", STRATEGY, 2),
    ("data analyst", "analytics_developer", STRATEGY, 2),
    ("creative director", "vp_creative_director", PLANNING_CREATIVE, 7),
    ("art director", "manager_art_director", PLANNING_CREATIVE, 3),
    ("project manager", "manager_project_manager", PLANNING_CREATIVE, 3),
    ("producer", "manager_content_producer", PLANNING_CREATIVE, 3),
    ("coordinator", "sr_project_coordinator", PLANNING_CREATIVE, 2),
    ("content producer", "manager_content_producer", PLANNING_CREATIVE, 3),
    ("event manager", "account_manager_prod", PRODUCTION, 3),
    ("hospitality manager", "account_manager_prod", PRODUCTION, 3),
    ("experience coordinator", "sr_account_executive_prod", PRODUCTION, 2),
    ("manager", "manager_project_manager", PLANNING_CREATIVE, 3),
    ("director", "account_director", CLIENT_SERVICES, 5),
    ("consultant", "account_manager", CLIENT_SERVICES, 3),
]
# all words of the first item must occur
ROLE_KEYWORDS = [
    (("account", "director"), "account_director", CLIENT_SERVICES, 5),
    (("account", "manager"), "account_manager", CLIENT_SERVICES, 3),
    (("account", "executive"), "account_executive", CLIENT_SERVICES, 1),
    (("creative", "director"), "vp_creative_director", PLANNING_CREATIVE, 7),
    (("strategy",), "planner_sponsorship_strategy", STRATEGY, 2),
    (("manager",), "manager_project_manager", PLANNING_CREATIVE, 3),
    (("director",), "account_director", CLIENT_SERVICES, 5),
]

# --- fixed values: organisation chart roles, in match order ----------------------
ORG_PRODUCTION = "integrated_production"
ORG_ROLES = [
    ("Exec Vice President", 9, CLIENT_SERVICES, ["EVP", "Executive VP", "Executive Vice President"]),
    ("Sr Vice President", 8, CLIENT_SERVICES, ["SVP", "Senior VP", "Senior Vice President"]),
    ("Vice President", 7, CLIENT_SERVICES, ["VP", "Vice Pres"]),
    ("Group Director", 6, CLIENT_SERVICES, ["Group Dir", "Group Director"]),
    ("Account Director", 5, CLIENT_SERVICES, ["Account Dir", "Account Director"]),
    ("Sr. Account Manager", 4, CLIENT_SERVICES, ["Senior Account Manager", "Sr Account Manager"]),
    ("Account Manager", 3, CLIENT_SERVICES, ["Account Mgr", "Account Manager"]),
    ("Sr. Account Executive", 2, CLIENT_SERVICES, ["Senior Account Executive", "Sr Account Executive"]),
    ("Account Executive", 1, CLIENT_SERVICES, ["Account Exec", "Account Executive"]),
    ("Account Trainee", 0, CLIENT_SERVICES, ["Trainee", "Account Trainee"]),
    ("Executive Vice President, Strategy", 9, STRATEGY, ["EVP Strategy", "Strategy EVP"]),
    ("Senior Vice President", 8, STRATEGY,
     ["SVP Innovation", "SVP Sponsorship Strategy", "SVP Digital Media", "SVP Social Media"]),
    ("Vice President", 7, STRATEGY,
     ["VP Sponsorship Strategy", "VP Innovation", "VP Digital Media", "VP Social Media"]),
    ("Group Director", 6, STRATEGY,
     ["Group Dir Sponsorship Strategy", "Group Dir CRM Strategy", "Group Dir Innovation",
      "Group Dir Digital Media", "Group Dir Social Media"]),
    ("Director", 5, STRATEGY,
     ["Director Analytics Developer", "Director UX/UI Innovation", "Director Digital Media",
      "Director Social Media", "Director Products Analytics", "Director CRM Strategy",
      "Director Sponsorship Strategy", "Director Experiential Strategist",
      "Director Sr Full Stack Developer"]),
    ("Senior Manager", 4, STRATEGY, ["Sr Manager"]),
    ("Manager", 3, STRATEGY,
     ["Manager Sponsorship Strategy", "Manager Research", "Manager CRM Strategy",
      "Manager Digital Copywriter", "Manager Digital Media", "Manager Social Media",
      "Manager Sponsorship Planner", "Manager Full Stack Developer", "Manager Account Executive CRM"]),
    ("Planner", 2, STRATEGY, ["Sponsorship Strategy Planner"]),
    ("Analyst", 2, STRATEGY, ["Digital Media Analyst", "Social Media Analyst"]),
    ("Analytics Developer", 2, STRATEGY, ["Analytics Dev"]),
    ("Digital Trainee", 1, STRATEGY, ["Jr Planner"]),
    ("Executive Vice President, Creative", 9, PLANNING_CREATIVE, ["EVP Creative", "Creative EVP"]),
    ("Senior Vice President", 8, PLANNING_CREATIVE, ["SVP Concept", "SVP Creative Services"]),
    ("Vice President", 7, PLANNING_CREATIVE,
     ["VP Executive Producer", "VP Creative Planner", "VP Creative Director"]),
    ("Group Director", 6, PLANNING_CREATIVE,
     ["Group Dir Creative Director", "Group Dir Creative Planner", "Group Dir Design"]),
    ("Director", 5, PLANNING_CREATIVE,
     ["ACD Design", "Associate Creative Director", "ACD 3D Design", "Sr Content Editor", "Sr Planner"]),
    ("Senior Manager", 4, PLANNING_CREATIVE, ["Sr Manager"]),
    ("Manager", 3, PLANNING_CREATIVE,
     ["Manager Content Producer", "Manager Content Editor", "Manager Project Manager",
      "Manager 3D Designer", "Manager Art Director", "Manager Jr"]),
    ("Producer", 2, PLANNING_CREATIVE, ["Strategist", "Sr Project Coordinator"]),
    ("Jr. Director", 1, PLANNING_CREATIVE, ["Jr Producer", "Jr Developer"]),
    ("Executive Vice President", 9, ORG_PRODUCTION, ["EVP"]),
    ("Senior Vice President", 8, ORG_PRODUCTION, ["SVP"]),
    ("Vice President", 7, ORG_PRODUCTION, ["VP"]),
    ("Group Director", 6, ORG_PRODUCTION, ["Group Dir"]),
    ("Account Director", 5, ORG_PRODUCTION, ["Account Dir"]),
    ("Sr. Account Manager", 4, ORG_PRODUCTION, ["Senior Account Manager"]),
    ("Account Manager", 3, ORG_PRODUCTION, ["Account Mgr"]),
    ("Sr. Account Executive", 2, ORG_PRODUCTION, ["Senior Account Executive"]),
    ("Account Executive", 1, ORG_PRODUCTION, ["Account Exec"]),
    ("Trainee", 0, ORG_PRODUCTION, ["Trainee"]),
]
ORG_DEPARTMENTS = [CLIENT_SERVICES, STRATEGY, PLANNING_CREATIVE, ORG_PRODUCTION]

# --- fixed values: wording patterns of role lists, in match order ---------------
ROLE_WORDING = [
    (r"project\s+manager", "Manager"),
    (r"account\s+manager", "Account Manager"),
    (r"account\s+executive", "Account Executive"),
    (r"account\s+director", "Account Director"),
    (r"creative\s+director", "Vice President"),
    (r"creative\s+manager", "Manager"),
    (r"strategy", "Manager"),
    (r"planner", "Planner"),
    (r"analyst", "Analyst"),
    (r"producer", "Producer"),
    (r"coordinator", "Sr Project Coordinator"),
    (r"director", "Director"),
    (r"manager", "Manager"),
    (r"executive", "Account Executive"),
    (r"vice\s+president", "Vice President"),
    (r"president", "Senior Vice President"),
]
BASELINE_FTE = {
    CLIENT_SERVICES: (0.75, 1.00),
    STRATEGY: (0.05, 0.25),
    PLANNING_CREATIVE: (0.05, 0.25),
    ORG_PRODUCTION: (0.95, 1.00),
}
OVERSIGHT_FTE = 0.05

# --- fixed values: title clean-up --------------------------------------------------
TITLE_ABBREVIATIONS = {
    "svp": "Senior Vice President",
    "evp": "Executive Vice President",
    "vp": "Vice President",
    "ad": "Account Director",
    "sam": "Senior Account Manager",
    "sae": "Senior Account Executive",
    "am": "Account Manager",
    "ae": "Account Executive",
    "gd": "Group Director",
    "sd": "Senior Director",
    "dir": "Director",
    "mgr": "Manager",
    "pm": "Project Manager",
    "ap": "Account Planner",
}
TITLE_LEVELS = {
    "executive vice president": 9,
    "senior vice president": 8,
    "vice president": 7,
    "group director": 6,
    "account director": 5,
    "senior account manager": 4,
    "account manager": 3,
    "senior account executive": 2,
    "account executive": 1,
}

# --- fixed values: staffing table headers ----------------------------------------
NAME_WORDS = ["name", "personnel", "staff"]
TITLE_WORDS = ["title", "role", "position"]
WORKSTREAM_WORDS = ["workstream", "discipline", "department"]
HEADER_SCORES = {"name": 3, "title": 3, "level": 1, "percent": 2, "hours": 3}
HEADER_SEARCH_ROWS = 3
HEADER_SAMPLE_ROWS = 5

# --- fixed values: project type words, first group that hits wins ---------------
PROJECT_TYPE_WORDS = [
    ("sponsorship_activation", ["sponsorship", "activation", "rights", "partnership"]),
    ("event_management", ["event", "hospitality", "guest", "venue", "ticketing"]),
    ("hospitality_program", ["hospitality", "guest management", "catering", "transportation"]),
    ("creative_campaign", ["creative", "campaign", "design", "content", "brand"]),
    ("strategic_planning", ["strategy", "planning", "research", "analysis", "recommendation"]),
    ("measurement_analytics", ["measurement", "analytics", "roi", "metrics", "reporting"]),
    ("content_production", ["production", "video", "photography", "content creation"]),
]
DEFAULT_PROJECT_TYPE = "sponsorship_activation"
SERVICE_TYPE_WORDS = [
    ("Sponsorship Hospitality", ["sponsorship", "hospitality", "guest", "event"]),
    ("Creative Campaign", ["creative", "campaign", "brand", "marketing"]),
    ("Event Management", ["event", "venue", "ticketing", "activation"]),
]
PROJECT_CATEGORY_WORDS = [
    ("Hospitality/Events", ["hospitality", "event", "hosting", "guest"]),
    ("Analytics/Measurement", ["measurement", "analytics", "reporting", "dashboard"]),
    ("Marketing/Activation", ["marketing", "brand", "campaign", "activation"]),
    ("Partnership Management", ["partnership", "platform", "management", "support"]),
]
TITLE_CATEGORY_WORDS = [
    ("Hospitality/Events", ["hospitality", "event", "hosting"]),
    ("Analytics/Measurement", ["measurement", "analytics", "reporting"]),
    ("Marketing/Activation", ["marketing", "brand", "campaign"]),
    ("Partnership Management", ["partnership", "platform", "support"]),
]
CATEGORY_SEARCH_TERMS = {
    "Hospitality/Events": ["hospitality", "event", "hosting"],
    "Analytics/Measurement": ["measurement", "analytics", "reporting"],
    "Marketing/Activation": ["marketing", "activation", "brand"],
}
CATEGORY_ADVICE = {
    "Hospitality/Events": ["Consider event managers and hospitality coordinators",
                           "Include client services and logistics support"],
    "Analytics/Measurement": ["Include data analysts and reporting specialists",
                              "Consider dashboard developers and insights managers"],
    "Marketing/Activation": ["Include brand managers and activation specialists",
                             "Consider creative directors and campaign managers"],
}
ROLE_CATEGORY_WORDS = [
    ("Account Management", ["account", "client", "relationship"]),
    ("Creative", ["creative", "design", "art", "copy", "content"]),
    ("Strategy", ["strategy", "strategist", "planning"]),
    ("Project Management", ["project", "program", "manager", "coordinator"]),
    ("Technical", ["developer", "engineer", "technical", "tech"]),
    ("Analytics", ["analyst", "data", "research"]),
]
DELIVERABLE_CATEGORY_WORDS = [
    ("Reports & Analysis", ["report", "analysis", "study", "audit"]),
    ("Creative Assets", ["creative", "design", "brand", "campaign", "materials"]),
    ("Strategic Documents", ["strategy", "plan", "roadmap", "framework"]),
    ("Technical Deliverables", ["system", "platform", "tool", "software"]),
]

# --- fixed values: requirement words ----------------------------------------------
BUDGET_POINT_WORDS = [(3, ["million", "multi-million", "enterprise"]),
                      (2, ["hundred thousand", "significant budget"])]
GEO_POINT_WORDS = [(3, ["global", "international", "worldwide"]), (2, ["national", "multi-market"])]
STAKEHOLDER_POINT_WORDS = ["multiple stakeholders", "cross-functional", "executive"]
COMPLEXITY_STEPS = [("enterprise", 12), ("complex", 9), ("moderate", 6)]
BUDGET_RANGE_WORDS = [
    ("enterprise", ["million", "multi-million", "enterprise"]),
    ("high", ["hundred thousand", "significant", "substantial"]),
    ("medium", ["thousand", "moderate", "standard"]),
]
LARGE_CLIENT_WORDS = ["fortune 500", "global", "international", "enterprise"]
LARGE_CLIENTS = ["company 1", "company 2", "company 3", "company 4"]
MID_CLIENT_WORDS = ["regional", "multi-market", "established"]
GEO_SCOPE_WORDS = [
    ("global", ["global", "international", "worldwide", "multi-country"]),
    ("national", ["national", "country-wide", "multi-market"]),
    ("regional", ["regional", "multi-city", "state-wide"]),
]
DELIVERABLE_MENTIONS = ["deliverable", "provide", "develop", "create", "produce"]
EVENT_MENTIONS = ["event", "activation", "program", "campaign"]
STAKEHOLDER_MENTIONS = ["stakeholder", "client", "partner", "team", "department"]
SPECIAL_WORDS = [
    "compliance", "regulatory", "legal", "security", "confidential",
    "international", "multi-language", "accessibility", "sustainability",
    "diversity", "inclusion", "crisis management", "risk management",
]

# --- fixed values: staffing rules ------------------------------------------------
COMPLEXITIES = ["simple", "moderate", "complex", "enterprise"]
# per project type: (client services, strategy, creative, production) for each complexity
DEPARTMENT_SPLIT = {
    "sponsorship_activation": [(.40, .20, .20, .20), (.35, .25, .25, .15), (.30, .30, .25, .15), (.25, .35, .25, .15)],
    "event_management": [(.30, .10, .20, .40), (.25, .15, .25, .35), (.20, .20, .30, .30), (.20, .25, .30, .25)],
    "hospitality_program": [(.40, .10, .10, .40), (.35, .15, .15, .35), (.30, .20, .20, .30), (.25, .25, .25, .25)],
    "creative_campaign": [(.30, .20, .40, .10), (.25, .25, .40, .10), (.20, .30, .40, .10), (.20, .35, .35, .10)],
}
# levels 9 down to 1
LEVEL_SPLIT = {
    "simple": [0, 0, .1, .2, .3, .2, .2, 0, 0],
    "moderate": [0, .05, .15, .25, .3, .15, .1, 0, 0],
    "complex": [.05, .1, .2, .25, .25, .1, .05, 0, 0],
    "enterprise": [.1, .15, .25, .25, .2, .05, 0, 0, 0],
}
BASE_FTE = {"simple": 1, "moderate": 2, "complex": 4, "enterprise": 6}
TYPE_FACTOR = {
    "event_management": 1.5, "hospitality_program": 1.3, "creative_campaign": 1.2,
    "sponsorship_activation": 1.0, "strategic_planning": 0.8, "measurement_analytics": 0.7,
    "content_production": 1.1, "partnership_management": 1.0,
}
MANY_EVENTS_FACTOR = 1.2
HOURLY_RATE = {"simple": 150, "moderate": 200, "complex": 275, "enterprise": 350}
LABOUR_SHARE = 0.8
# (title, level, low, high, reason)
TYPE_ROLES = {
    "sponsorship_activation": [
        ("Account Director", 5, 25.0, 40.0, "Lead client relationship and program oversight"),
        ("Strategy Director", 5, 20.0, 35.0, "Strategic planning and sponsorship activation"),
    ],
    "event_management": [
        ("Account Manager", 3, 30.0, 50.0, "Day-to-day client management"),
        ("Event Manager", 3, 40.0, 60.0, "Event execution and logistics"),
    ],
}
COMPLEX_ROLE = ("Vice President", 7, 10.0, 20.0, "Executive oversight for complex project")
CREATIVE_DIRECTOR_PCT = 5.0
OVERSIGHT_PCT = 5.0
SPONSORSHIP_CLIENT_PCT = 25.0
SPONSORSHIP_PERSON_PCT = 50.0
CLIENT_SERVICES_MIN, CLIENT_SERVICES_MAX = 75.0, 100.0
EXPERIENCES_PCT, EXPERIENCES_FLOOR = 100.0, 80.0
CREATIVE_MIN, CREATIVE_MAX = 5.0, 25.0
MIN_POD = 4
PLAN_CONFIDENCE = 0.85
ROLE_CONFIDENCE = 0.90
PLAN_COMPLETENESS = 0.95

# --- fixed values: search ------------------------------------------------------
SYNONYMS_LONG = {
    "golf": ["masters", "augusta", "tournament", "championship", "golf club", "pga"],
    "augusta": ["august", "masters", "golf", "tournament", "national golf club"],
    "masters": ["augusta", "golf", "tournament", "championship", "masters tournament"],
    "hospitality": ["hosting", "event", "guest", "hospitality program", "entertainment"],
    "event": ["hospitality", "hosting", "program", "event management", "conference"],
    "sponsorship": ["sponsor", "partnership", "brand", "activation", "marketing"],
    "measurement": ["analytics", "reporting", "tracking", "metrics", "data"],
    "marketing": ["activation", "brand", "campaign", "promotion", "advertising"],
}
SYNONYMS_SHORT = {
    "golf": ["masters", "augusta", "tournament", "championship", "golf club"],
    "augusta": ["august", "masters", "golf", "tournament"],
    "masters": ["augusta", "golf", "tournament", "championship"],
    "hospitality": ["hosting", "event", "guest", "hospitality program"],
    "event": ["hospitality", "hosting", "program", "event management"],
    "sponsorship": ["sponsor", "partnership", "brand", "activation"],
    "measurement": ["analytics", "reporting", "tracking", "metrics"],
    "marketing": ["activation", "brand", "campaign", "promotion"],
}
SOUND_ALIKE = {"august": "augusta", "augusta": "august"}
LADDERS = {
    "semantic_first": [("semantic_vector", 1.0), ("semantic_lexical", 0.9), ("fuzzy_match", 0.8),
                       ("synonym_match", 0.7), ("term_match", 0.6)],
    "exact_first": [("exact_match", 1.0), ("fuzzy_match", 0.8), ("phonetic_match", 0.75),
                    ("synonym_match", 0.7), ("term_match", 0.6)],
    "phonetic_first": [("phonetic_match", 1.0), ("fuzzy_match", 0.95), ("exact_match", 0.9),
                       ("synonym_match", 0.8), ("term_match", 0.7)],
}
SEARCH_FIELD_WEIGHTS = {"project_title": 3.0, "scope_summary": 2.0, "deliverables": 2.0, "client_name": 1.0}

# --- fixed values: staffing section words ---------------------------------------
WINDOW_WORDS = ["staffing", "staff plan", "personnel", "team", "resources", "fees"]
WIDE_WINDOW_WORDS = [
    "staffing", "staff plan", "personnel", "team", "resources", "fees",
    "workstream", "fte", "hours", "% time", "allocation", "workforce",
    "resource table", "workstream distribution", "team members",
]
TITLE_BLOCK = "Title Discipline Hours"
SECTION_STARTS = [
    r"project\s+staffing\s+plan", r"staffing\s+plan", r"team\s+structure",
    r"personnel\s+allocation", r"resource\s+allocation", r"name\s+role\s+primary\s+role",
]

# --- fixed values: date formats and term patterns ---------------------------------
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
MONTHS_SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATE_FORMATS = [
    rf"\b(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b",
    rf"\b(?:{MONTHS_SHORT})\.?\s+\d{{1,2}},?\s+\d{{4}}\b",
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    rf"\b\d{{1,2}}\s+(?:of\s+)?(?:{MONTHS})\s+\d{{4}}\b",
]
LOOSE_DATES = [
    rf"\b(?:{MONTHS_SHORT})[a-z]*\.?\s+\d{{1,2}},?\s+\d{{4}}\b",
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
]
TIMELINE_TERMS = [rf"\b({MONTHS_SHORT})[a-z]*\.?\s+\d{{1,2}},?\s+\d{{4}}\b"] + LOOSE_DATES[1:] + [r"\b(?:weeks?|months?|years?)\b", r"\b(?:Q[1-4]|Quarter [1-4])\b"]
BUDGET_TERMS = [
    r"\$\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b",
    r"\b\d{1,6}\s*(?:USD|dollars?)\b",
    r"\b(?:rate|fee|cost|budget|pricing)\b",
    r"\b(?:per hour|hourly|daily|monthly)\b",
    r"\b(?:FTE|full.?time|part.?time)\b",
]
_MONTH_WORDS = MONTHS_SHORT.lower().split("|")
#: Lower-case words of which a text has one where it has a match of the pattern at the same place.
TIMELINE_NEEDS = [_MONTH_WORDS, ["/"], ["-"], ["week", "month", "year"], ["q1", "q2", "q3", "q4", "quarter "]]
BUDGET_NEEDS = [["$"], ["usd", "dollar"]]
SECTION_TERMS = [
    "Scope of Work|Scope|Project Scope", "Deliverables?|Deliverables",
    "Timeline|Schedule|Duration|Project Timeline", "Budget|Cost|Pricing|Fees|Rates",
    "Roles?|Staffing|Team|Personnel", "Responsibilities?|Duties",
    "Assumptions?|Constraints|Limitations", "Success Criteria|Metrics|KPIs",
    "Risk|Risks|Risk Management", "Communication|Reporting|Updates",
]
ROLE_TERMS = [
    "Account Manager|Account Director", "Creative Director|Art Director",
    "Project Manager|Program Manager", "Strategy Director|Strategy Manager|Strategist",
    "Analyst|Business Analyst|Data Analyst", "Designer|Graphic Designer|UI/UX Designer",
    "Developer|Engineer|Software Engineer", "Coordinator|Project Coordinator",
    "Producer|Content Producer", "Consultant|Senior Consultant",
    "Director|Senior Director|VP|Vice President",
]
DELIVERABLE_TERMS = [
    r"(?:deliver|provide|submit|create|develop)\s+([^.!?]*(?:report|document|plan|strategy|analysis|design"
    r"|campaign|materials)[^.!?]*)",
    r"deliverables?[:\-]\s*([^.!?]*)",
]
DELIVERABLE_NEEDS = [[verb + space for verb in ("deliver", "provide", "submit", "create", "develop") for space in " \t\n\x0b\f\r"],
                     ["deliverable:", "deliverables:", "deliverable-", "deliverables-"]]
CLIENT_TERMS = [
    r"(?:client|company|organization):\s*([A-Za-z0-9\s&.,-]+)",
    r"(?:between|with)\s+([A-Z][A-Za-z0-9\s&.,-]+)\s+(?:and|&)",
]
KEY_PHRASE_WORDS = ["scope", "deliverable", "timeline", "budget", "role", "responsibility", "milestone"]
FIRST_PASS_ROLES = "Account|Manager|Director|Analyst|Coordinator|Designer|Strategist|Producer|Engineer"
ROLE_LINE_TERMS = [
    "Account Director|Account Manager|Account Executive|AE|SAE",
    "Creative Director|Art Director|Copywriter|Designer",
    "Strategy Director|Strategy Manager|Strategist|Planner",
    "Sponsorship Director|Sponsorship Manager|Partnership Manager",
    "Event Director|Event Manager|Hospitality Manager|Experience Coordinator",
    "Business Development|BD Director|BD Manager|New Business Manager",
    "Analytics Director|Data Analyst|Analyst|Measurement Specialist",
    "Media Director|Media Manager|Digital Specialist|Social Media Manager",
    "Project Manager|Program Manager|Coordinator",
]
ROLE_LIST_TERMS = [
    r"account\s+director|project\s+manager|senior\s+account\s+executive|account\s+executive"
    r"|manager|director|lead|coordinator|specialist",
    r"[A-Z][a-z]+\s+[A-Z][a-z]+",
]
HOUR_TERMS = [r"(\d+)\s*hours?", r"(\d+)\s*hrs?", r"(\d+)\s*hr"]
FTE_TERMS = [r"(\d+(?:\.\d+)?)\s*%?\s*FTE", r"(\d+(?:\.\d+)?)\s*%?\s*full\s*time"]
ROLE_VALUE_TERMS = [
    r"([A-Za-z\s]+)\s+(\d+)\s*hours?",
    r"([A-Za-z\s]+)\s+(\d+)\s*hrs?",
    r"([A-Za-z\s]+)\s+(\d+(?:\.\d+)?)\s*%?\s*FTE",
]
#: Number, unit and a word of the unit in lower case, of each of these.
ROLE_VALUE_PARTS = [(r"\d+", r"\s*hours?", "hour"), (r"\d+", r"\s*hrs?", "hr"), (r"\d+(?:\.\d+)?", r"\s*%?\s*FTE", "fte")]

# --- fixed values: extraction wording by field -------------------------------------
LIST_MARKS = ["•", "▪", "○", "◦", "‣", "⁃", "-", "–", "—",
              "1.", "2.", "3.", "4.", "5.", "a.", "b.", "c.", "d.", "e."]
FIELD_WORDING = {
    "client_name": {
        "contract_indicators": ["between", "agreement between", "contract between", "services for",
                                "work for", "engagement with", "retainer with"],
        "label_indicators": ["client:", "company:", "customer:", "contractor:", "client name:",
                             "company name:", "customer name:"],
        "signature_indicators": ["client signature", "company signature", "authorized by",
                                 "on behalf of", "representing", "signed by"],
        "exclusion_patterns": ["contractor", "vendor", "service provider", "consultant", "agency"],
        "corporate_suffixes": ["inc.", "incorporated", "corp.", "corporation", "llc", "ltd.", "limited",
                               "co.", "company", "group", "holdings", "partners", "associates"],
    },
    "project_title": {
        "title_indicators": ["project title:", "project name:", "work title:", "engagement title:",
                             "scope title:", "statement of work for", "services for"],
        "section_headers": ["project overview", "project description", "scope of work",
                            "work statement", "project scope"],
        "exclusion_patterns": ["confidential", "proprietary", "internal use", "draft", "template"],
    },
    "start_date": {
        "primary_indicators": ["start date", "service start date", "project start", "commencement date",
                               "effective date", "begin date", "initiation date", "work start"],
        "secondary_indicators": ["start:", "beginning:", "effective:", "commencement:", "initiation:"],
        "context_patterns": ["services start date:", "project start date:", "contract start:", "work begins:",
                             "engagement starts:", "retainer begins:", "effective as of:"],
        "date_formats": DATE_FORMATS,
    },
    "end_date": {
        "primary_indicators": ["end date", "service end date", "project end", "completion date",
                               "termination date", "expiration date", "finish date", "work end"],
        "secondary_indicators": ["end:", "completion:", "termination:", "expiration:", "finish:", "conclusion:"],
        "context_patterns": ["services end date:", "project end date:", "contract end:", "work ends:",
                             "engagement ends:", "retainer ends:", "through:", "until:"],
        "duration_indicators": ["through", "until", "ending", "concluding", "expires", "terminates"],
        "date_formats": DATE_FORMATS,
    },
    "project_length": {
        "duration_indicators": ["project length", "duration", "term", "period", "timeline",
                                "project timeline", "engagement period"],
        "time_units": ["months", "month", "mo", "m", "weeks", "week", "wk", "w",
                       "days", "day", "d", "years", "year", "yr", "y"],
        "duration_patterns": [
            r"\d+\s*(?:months?|mo\.?|m)", r"\d+\s*(?:weeks?|wk\.?|w)", r"\d+\s*(?:days?|d)",
            r"\d+\s*(?:years?|yr\.?|y)", r"\d+\s*-\s*\d+\s*(?:months?|weeks?|days?)",
            r"\d+\s*to\s*\d+\s*(?:months?|weeks?|days?)"],
        "approximate_indicators": ["approximately", "approx", "about", "around", "roughly",
                                   "estimated", "expected"],
    },
    "scope_summary": {
        "section_headers": ["scope of work", "project scope", "work statement", "project description",
                            "overview", "summary", "background", "objectives"],
        "introductory_phrases": ["the purpose of this", "this project involves", "the scope includes",
                                 "work will include", "services will consist of", "the engagement will"],
        "exclusion_patterns": ["confidential", "proprietary", "internal", "draft", "template"],
    },
    "deliverables": {
        "section_headers": ["deliverables", "scope of work", "work product", "outputs", "deliverable items",
                            "project deliverables", "key deliverables", "work products"],
        "list_indicators": LIST_MARKS + ["i.", "ii.", "iii.", "iv.", "v."],
        "action_verbs": ["provide", "deliver", "create", "develop", "produce", "generate", "submit",
                         "present", "complete", "implement", "execute", "design", "build",
                         "establish", "maintain", "support"],
        "deliverable_indicators": ["deliverable", "output", "product", "report", "document", "analysis",
                                   "strategy", "plan", "recommendation"],
    },
    "exclusions": {
        "section_headers": ["exclusions", "not included", "out of scope", "excluded", "not covered",
                            "outside scope", "limitations"],
        "exclusion_indicators": ["excludes", "not include", "out of scope", "not covered",
                                 "not responsible for", "beyond scope", "not part of"],
        "list_indicators": LIST_MARKS,
    },
    "staffing_plan": {
        "section_headers": ["staffing plan", "staff plan", "personnel", "team", "resources", "fees",
                            "project team", "key personnel", "staffing table", "resource allocation"],
        "table_indicators": ["title discipline hours", "name", "role", "allocation", "fte", "hours",
                             "percentage", "time", "position", "level", "title", "discipline"],
        "role_patterns": [
            r"\b(?:EVP|SVP|VP|Director|Manager|Executive|Analyst|Coordinator|Lead|Specialist)\b",
            r"\b(?:Account|Project|Program|Client|Senior|Junior|Associate|Principal)\s+"
            r"(?:Director|Manager|Executive|Analyst|Coordinator|Lead)\b",
            r"\b(?:Vice\s+)?President\b",
            r"\b(?:Senior\s+)?(?:Account|Project|Program|Client)\s+(?:Executive|Manager|Director)\b"],
        "allocation_patterns": [r"\d+(?:\.\d+)?\s*%", r"\d+\s*hrs?", r"\d+\s*hours?",
                                r"\d+(?:\.\d+)?\s*fte", r"\d+\s*-\s*\d+\s*hrs?", r"\d+\s*to\s*\d+\s*hrs?"],
        "location_indicators": [
            r"\b(?:US|UK|USA|United States|United Kingdom|Canada|Mexico)\b",
            r"\b(?:New York|Los Angeles|Chicago|Houston|Phoenix|Philadelphia|San Antonio|San Diego"
            r"|Dallas|San Jose)\b"],
    },
}
#: Words of which a text has one of each list where it has a match of the pattern.
PATTERN_NEEDS = {
    **{p: [MONTHS_SHORT.lower().split("|")] for p in (DATE_FORMATS[0], DATE_FORMATS[1], DATE_FORMATS[4])},
    DATE_FORMATS[2]: [["/", "-"]], DATE_FORMATS[3]: [["-"]],
    r"\d+\s*-\s*\d+\s*(?:months?|weeks?|days?)": [["-"], ["month", "week", "day"]],
    r"\d+\s*to\s*\d+\s*(?:months?|weeks?|days?)": [["to"], ["month", "week", "day"]],
    r"\b(?:Vice\s+)?President\b": [["president"]],
    r"\d+(?:\.\d+)?\s*%": [["%"]], r"\d+\s*hrs?": [["hr"]], r"\d+\s*hours?": [["hour"]], r"\d+(?:\.\d+)?\s*fte": [["fte"]],
    r"\d+\s*-\s*\d+\s*hrs?": [["-"], ["hr"]], r"\d+\s*to\s*\d+\s*hrs?": [["to"], ["hr"]],
    r"\d+\s*(?:years?|yr\.?|y)": [["y"]],
    FIELD_WORDING["staffing_plan"]["location_indicators"][1]: [[
        "new york", "los angeles", "chicago", "houston", "phoenix", "philadelphia", "san antonio", "san diego", "dallas", "san jose"]],
}
COMPARED_FIELDS = ["client_name", "project_title", "start_date", "end_date", "project_length",
                   "scope_summary", "deliverables", "exclusions", "staffing_plan"]

# --- fixed values: field flags of a recommended table ---------------------------------
SEARCHABLE_FIELDS = ["client_name", "project_title", "scope_summary", "deliverables", "exclusions"]
SORTED_FIELDS = ["client_name", "start_date", "end_date", "project_length", "file_name"]
FACET_FIELDS = ["client_name", "project_length"]
