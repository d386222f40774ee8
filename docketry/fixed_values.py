"""Word lists, formats and messages that decide the results.

Everything in this module is data that must stay exactly as it is for results
to be right.  No logic lives here.  The field rules themselves are data too
and live in ``packs/*.json``.
"""

# --- fixed values: calendar -------------------------------------------------
MONTHS = (
    "January", "February", "March", "April", "May", "June", "July", "August",
    "September", "October", "November", "December",
)
NUMERIC_DATE = r"(\d{1,2})/(\d{1,2})/(\d{4})"
MONTH_NAME_DATE = (
    r"(January|February|March|April|May|June|July|August|September|October|November|December)"
    r"\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"
)
DASHED_DATE = r"(\d{1,2})-(\d{1,2})-(\d{4})"
PADDED_NUMERIC_DATE = r"^\d{2}/\d{2}/\d{4}$"

# --- fixed values: which fields hold dates, which dates are incidents --------
DATE_FIELD_INDICATORS = (
    "facts_date", "incident_date", "contract_date", "accident_date", "date_of_incident",
    "numeric_date", "advanced_incident_date", "contextual_incident_search",
    "fuzzy_incident_date", "at_time_pattern", "subject_incident_date", "loss_date",
    "multiple_dates_extractor",
)
FILING_FIELD_INDICATORS = ("filed_date", "filing_date")
FILING_FIELD_CONTEXT = ("on or about", "occurred on", "happened on", "incident on")
INCIDENT_FIELD_INDICATORS = ("facts_date", "incident_date", "accident_date")
INCIDENT_CONTEXT = ("on or about", "occurred on", "happened on")
AMBIGUOUS_FIELDS = ("numeric_date", "multiple_dates_extractor", "advanced_incident_date")
AMBIGUOUS_CONTEXT = ("on or about", "occurred", "happened", "incident", "accident", "collision")
MULTI_DATE_FIELD = "multiple_dates_extractor"
KNOWN_FILING_DATES = ("July 7, 2025", "July 18, 2025")
MULTI_DATE_SEPARATOR = " | "
NOT_AVAILABLE = "NA"
NULL_COMPARE_ERROR = "'<' not supported between instances of 'str' and 'NoneType'"

# --- fixed values: field rule defaults and scores ----------------------------
LINE_TOLERANCE = 10
FOLLOWING_ELEMENTS = 19
FACTS_WINDOW = (50, 200)
TITLE_WINDOW = (100, 100)
TITLE_KEYWORDS = ("vs.", "v.", "versus")
TITLE_CASE_NUMBER = r"\d{4}-[A-Z]{2}-\d{6}-[A-Z]"
TITLE_MIN_LENGTH = 5
FUZZY_WINDOW = (200, 300)
FUZZY_SUBSTITUTIONS = (("\\s+", "\\s*"), (",", "[,.]?"), (":", "[:\\-\\s]*"))
SCORED_CONTEXT = 100
SCORED_CONTEXT_WORDS = ("incident", "accident", "occurred", "happened", "facts")
SCORED_LENGTH_WEIGHT = 0.1
SCORED_WORD_WEIGHT = 0.2
SECONDARY_KEYWORD_WEIGHT = 0.5
MULTI_DATE_TOP = 3
MULTI_DATE_SHOWN_INDICATORS = 2
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
EMAIL_MIN_LENGTH = 5

# --- fixed values: text normalisation ----------------------------------------
PUNCTUATION = ".,;:!?()[]{}\"'\\-_"
# every character Python's str.strip() and str.split() treat as blank
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: plaintiff contact block -----------------------------------
STRICT_TRIGGERS = (
    "PLAINTIFF HEREBY DEMANDSA JURYTRIAL ON ALL ISSUES SO TRIABLE.",
    "Plaintiff demands trial by jury on all issues triable as of right.",
)
BATCH_TRIGGERS = STRICT_TRIGGERS + (
    "jury demand", "jury trial demanded", "plaintiff demands", "plaintiff hereby demands",
)
FUZZY_TRIGGER_RATIO = 0.8
CONTACT_WINDOW = 500
CONTACT_CUTOFF_TERMS = (
    "attorneys for plaintiff", "benefits", "explanation", "patient", "transaction", "history",
    "charges",
)
CONTACT_REMOVE_TERMS = (
    "hereby", "demands", "jury", "trial", "issues", "triable", "respectfully", "submitted", "this",
)

# --- fixed values: catalog, report, messages ---------------------------------
EXTRACTED_BY = "individual_pdf_service"
INDIVIDUAL_COUNTY = "individual"
DEFAULT_COUNTY = "unknown"
STORE_NAMES = ("MongoDB", "PostgreSQL")
DEFAULT_WINDOW_DAYS = 365
CATALOG_ID_LENGTH = 24
REPORT_COLUMNS = (
    "PDF File", "County", "MongoDB Doc ID", "Incident Date", "Incident End Date",
    "Standard Incident Date", "Standard Incident End Date", "Is Incident", "All Dates Count",
    "Multiple Dates", "Standard Multiple Dates", "Emails", "Status",
)
MULTI_DATE_REPORT_LENGTH = 100
