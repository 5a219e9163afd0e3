"""Vocabularies and lookup tables that results depend on.

Everything here is data, stated in natural order.  No logic lives here.
"""

# -- categories and instruments (fixed values) ------------------------------
TAX_CATEGORIES = ["property", "sales_use", "income_payroll", "lodging_meals", "other_levy"]
STATE_PASS = "framework"
COUNTY_PASS = "elections"
WORK_CATEGORIES = TAX_CATEGORIES + [STATE_PASS, COUNTY_PASS]

INSTRUMENTS_BY_CATEGORY = {
    "property": [
        "general_operating_levy", "debt_service_levy", "special_district_levy",
        "tif_increment", "assessment_ratio", "homestead_exemption", "rate_cap",
        "levy_growth_limit", "assessment_growth_limit"],
    "sales_use": [
        "local_option_sales", "county_general_sales", "municipal_general_sales",
        "special_purpose_sales", "transit_district_sales", "use_tax",
        "gross_receipts", "sales_tax_cap"],
    "income_payroll": [
        "local_income_tax", "earnings_tax", "occupational_license",
        "payroll_expense", "net_profits", "intangibles"],
    "lodging_meals": [
        "transient_lodging", "hotel_motel", "food_beverage", "tourism_district"],
    "other_levy": [
        "franchise_fee", "utility_users", "business_license", "impact_fee",
        "special_assessment", "real_estate_transfer", "local_motor_fuel",
        "amusement_admissions", "severance"],
}
INSTRUMENTS = [c for codes in INSTRUMENTS_BY_CATEGORY.values() for c in codes]
RATELESS_INSTRUMENTS = ["assessment_ratio", "homestead_exemption"]

# -- closed vocabularies (fixed values) -------------------------------------
STATUSES = ["levied", "authorized_not_levied", "prohibited", "repealed", "unknown"]
RATE_UNITS = ["percent", "mills", "dollars_per_1000_av", "usd_flat", "usd_per_unit", "ratio"]
CAP_TYPES = ["rate_cap", "levy_growth_cap", "assessment_cap", "aggregate_cap", "none"]
CONFIDENCE = ["high", "medium", "low"]
WORK_STATUSES = ["pending", "in_progress", "needs_review", "complete", "no_data",
                 "blocked", "awaiting_ai"]
SOURCE_TYPES = ["statute", "agency_table", "bulk_file", "ordinance", "portal", "secondary"]
KINDS = ["state", "county", "place", "mcd", "school"]
TERNARY = ["yes", "no", "conditional", "unknown"]
MEASURE_CLASSES = [
    "tax_new", "tax_increase", "tax_extension", "tax_increase_and_extension",
    "tax_renewal", "tax_repeal", "bond_go", "bond_revenue", "levy_override",
    "levy_renewal", "assessment_district", "de_bruce", "charter_fiscal",
    "advisory", "other"]
REVENUE_CLASSES = [
    "tax_new", "tax_increase", "tax_extension", "tax_increase_and_extension",
    "tax_renewal", "bond_go", "bond_revenue", "levy_override", "levy_renewal",
    "assessment_district", "de_bruce", "charter_fiscal"]
THRESHOLD_BASES = ["votes_cast", "registered_voters", "dual_majority",
                   "votes_cast_plus_turnout_validation", "governing_body_only"]
VOTES_CAST_BASES = ["votes_cast", "votes_cast_plus_turnout_validation"]
ELECTION_TYPES = ["general", "primary", "special", "consolidated", "mail_only",
                  "annual_town_meeting"]
OUTCOMES = ["passed", "failed", "withdrawn", "pending", "invalidated", "unknown"]
PURPOSES = ["general", "special", "either"]
PERMITTED = ["yes", "no", "conditional"]
HOME_RULE = ["dillon", "home_rule", "mixed", "unknown"]
LIMIT_TYPES = ["rate_cap", "levy_growth_cap", "assessment_cap", "combined", "none", "unknown"]
PROFILE_VOCAB = {
    "home_rule_doctrine": HOME_RULE,
    "property_tax_limit_type": LIMIT_TYPES,
    "local_sales_tax_allowed": TERNARY,
    "local_income_tax_allowed": TERNARY,
    "local_lodging_tax_allowed": TERNARY,
}
PROFILE_FREE_FIELDS = ["property_tax_limit_summary", "local_sales_tax_max",
                       "statute_root_url", "revenue_agency", "revenue_agency_url", "notes"]
COMPLETENESS_ORDER = ["complete", "substantial", "partial", "spot_checked", "none"]
SCOPE_TYPE_BY_KIND = {"state": "state", "county": "county", "place": "place",
                      "mcd": "place", "school": "place"}

# -- work ledger (fixed values) ---------------------------------------------
KIND_WEIGHT = {"state": 1000, "county": 100, "place": 10, "mcd": 5, "school": 20}
PASS_KIND = {STATE_PASS: "state", COUNTY_PASS: "county"}
BULK_NOTE = "filled from a published bulk rate file; no human review needed"

# -- states: FIPS code, postal code, name (fixed values) --------------------
STATES = [
    ("01", "AL", "Alabama"), ("02", "AK", "Alaska"), ("04", "AZ", "Arizona"),
    ("05", "AR", "Arkansas"), ("06", "CA", "California"), ("08", "CO", "Colorado"),
    ("09", "CT", "Connecticut"), ("10", "DE", "Delaware"),
    ("11", "DC", "District of Columbia"), ("12", "FL", "Florida"),
    ("13", "GA", "Georgia"), ("15", "HI", "Hawaii"), ("16", "ID", "Idaho"),
    ("17", "IL", "Illinois"), ("18", "IN", "Indiana"), ("19", "IA", "Iowa"),
    ("20", "KS", "Kansas"), ("21", "KY", "Kentucky"), ("22", "LA", "Louisiana"),
    ("23", "ME", "Maine"), ("24", "MD", "Maryland"), ("25", "MA", "Massachusetts"),
    ("26", "MI", "Michigan"), ("27", "MN", "Minnesota"), ("28", "MS", "Mississippi"),
    ("29", "MO", "Missouri"), ("30", "MT", "Montana"), ("31", "NE", "Nebraska"),
    ("32", "NV", "Nevada"), ("33", "NH", "New Hampshire"), ("34", "NJ", "New Jersey"),
    ("35", "NM", "New Mexico"), ("36", "NY", "New York"), ("37", "NC", "North Carolina"),
    ("38", "ND", "North Dakota"), ("39", "OH", "Ohio"), ("40", "OK", "Oklahoma"),
    ("41", "OR", "Oregon"), ("42", "PA", "Pennsylvania"), ("44", "RI", "Rhode Island"),
    ("45", "SC", "South Carolina"), ("46", "SD", "South Dakota"), ("47", "TN", "Tennessee"),
    ("48", "TX", "Texas"), ("49", "UT", "Utah"), ("50", "VT", "Vermont"),
    ("51", "VA", "Virginia"), ("53", "WA", "Washington"), ("54", "WV", "West Virginia"),
    ("55", "WI", "Wisconsin"), ("56", "WY", "Wyoming"), ("72", "PR", "Puerto Rico"),
]
# Census government ids number the states 01-51 in FIPS order; Puerto Rico has none.
CENSUS_STATES = [(f, "%02d" % i, u, n) for i, (f, u, n) in
                 enumerate([s for s in STATES if s[1] != "PR"], start=1)]
# va.gov belongs to a federal department, so this code is never read off a host.
CODES_NOT_IN_HOSTS = ["VA"]

# -- quarterly rate files (fixed values) ------------------------------------
# authority type -> category, instrument, expected kind, label
RATE_FILE_TYPES = {
    "00": ("sales_use", "county_general_sales", "county", "county general sales tax"),
    "01": ("sales_use", "municipal_general_sales", "place", "municipal general sales tax"),
    "02": ("sales_use", "municipal_general_sales", "place", "town general sales tax"),
    "03": ("sales_use", "municipal_general_sales", "place", "village general sales tax"),
    "04": ("sales_use", "municipal_general_sales", "place", "borough general sales tax"),
    "05": ("sales_use", "municipal_general_sales", "mcd", "township general sales tax"),
    "09": ("sales_use", "municipal_general_sales", "place", "municipal general sales tax"),
}
STATE_AUTHORITY_TYPE = "45"
TOWNSHIP_TYPE = "05"
STALE_BEFORE_YEAR = 2025

# -- finance files (fixed values) -------------------------------------------
# item -> base type, category
FINANCE_ITEMS = {
    "T01": ("collections_property", "property"),
    "T09": ("collections_sales_use", "sales_use"),
    "T19": ("collections_lodging_meals", "lodging_meals"),
    "T40": ("collections_income_payroll", "income_payroll"),
}

# -- place names (fixed values) ---------------------------------------------
CIVIC_SUFFIXES = [
    "city and borough", "and borough", "census area", "municipality", "borough",
    "county", "parish", "city", "town", "village", "cdp", "township",
    "charter township", "plantation", "gore"]

# -- plausibility (fixed values) --------------------------------------------
PLAUSIBLE_RANGE = {
    "percent": (0.0, 25.0), "mills": (0.0, 500.0), "dollars_per_1000_av": (0.0, 100.0),
    "ratio": (0.0, 1.5), "usd_flat": (0.0, 1000000.0), "usd_per_unit": (0.0, 100000.0),
}
NOT_A_TAX_TERMS = ["reimburs", "per diem", "travel allowance", "lodging allowance",
                   "mileage rate", "expense allowance"]
# flag code -> advised lean; codes not listed get "unsure"
ADVICE_LEAN = {
    "not_a_tax": "try_again", "implausible_rate": "try_again",
    "status_conflict": "unsure", "over_cap": "try_again",
    "date_regression": "unsure", "undated_supersede": "unsure",
    "no_result": "try_again", "future_result": "try_again",
    "threshold_scale": "try_again",
}
LEAN_STATUS = {"publish": "complete", "try_again": "pending", "no_such_tax": "no_data"}

# -- instruments worth asking about first, by category (fixed values) -------
ASK_FIRST = {
    "property": ["general_operating_levy", "debt_service_levy", "rate_cap",
                 "levy_growth_limit", "assessment_ratio"],
    "income_payroll": ["local_income_tax", "earnings_tax", "occupational_license"],
    "lodging_meals": ["transient_lodging", "food_beverage"],
    "other_levy": ["franchise_fee", "utility_users", "real_estate_transfer",
                   "business_license"],
}
ASK_FIRST_SALES = {
    "county": ["county_general_sales", "local_option_sales", "use_tax",
               "special_purpose_sales", "sales_tax_cap"],
    "place": ["municipal_general_sales", "local_option_sales", "use_tax",
              "special_purpose_sales", "sales_tax_cap"],
    "*": ["local_option_sales", "sales_tax_cap"],
}

# -- statute search terms (fixed values) ------------------------------------
DEFAULT_STATUTE_TERMS = [
    "sales tax", "use tax", "lodging", "hotel", "transient", "property tax",
    "millage", "levy", "income tax", "occupational", "earnings tax", "franchise",
    "excise", "voter approval", "charter"]
STATUTE_TERMS = {
    "sales_use": ["sales tax", "use tax", "gross receipts", "local option"],
    "lodging_meals": ["lodging", "hotel", "transient", "occupancy", "meals"],
    "property": ["property tax", "millage", "levy limit", "assessment"],
    "income_payroll": ["income tax", "earnings tax", "occupational"],
    "other_levy": ["franchise", "excise", "transfer tax", "utility tax"],
    "framework": ["three-fifths", "two-thirds", "sixty percent",
                  "majority of the electors", "shall not exceed",
                  "submitted to the electors", "special election", "levy limit",
                  "home rule"],
    "elections": ["canvass", "certif", "submitted to the electors", "ballot",
                  "special election"],
}

# -- page keywords and hosts (fixed values) ---------------------------------
TAX_PAGE_PATTERN = (
    "tax|levy|levies|millage|ordinance|lodging|hotel|motel|occupancy|sales.?tax|"
    "property.?tax|excise|assessment|revenue|franchise|transient|meals|rate.?table|"
    "local.?option|withholding|earnings.?tax|statute|municipal.?code|charter|"
    "ballot|measure|canvass|election|proposition|referend|abstract.?of.?votes|"
    "official.?results|certif")
ELECTION_PAGE_PATTERN = (
    "ballot|measure|canvass|election|proposition|referend|levy|bond|abstract|"
    "official.?results|certif|precinct|sample.?ballot|issue")
OFFICE_PATTERN = (
    "treasur|auditor|finance|revenue|tax|commission|clerk|ordinance|"
    "municipal.?code|budget|assessor|collector")
STATUTE_HOST_PATTERN = (
    "legis|legislature|statute|codes?\\.|municode|amlegal|generalcode|ecode360|"
    "library\\.municode|law\\.justia|casetext|lawserver")
STATUTE_PATH_PATTERN = (
    "/statute|/code|/ordinance|/charter|/constitution|/title\\d|/chapter")
DOCUMENT_EXTENSIONS = [".pdf", ".csv", ".xls", ".xlsx"]
SKIPPED_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico", ".css", ".js", ".woff",
    ".woff2", ".ttf", ".mp4", ".mp3", ".zip", ".exe", ".dmg"]
BLOCKED_HOST_PARTS = [
    "facebook.com", "twitter.com", "x.com", "linkedin.com", "youtube.com",
    "instagram.com", "tiktok.com", "doubleclick.net", "google.com",
    "googletagmanager.com", "apple.com", "bing.com", "microsoft.com",
    "duckduckgo.com", "wikipedia.org", "wikiwand.com", "yelp.com", "yellowpages.com"]
MEDIA_HOST_PARTS = [
    "news", "times", "tribune", "herald", "gazette", "blog", "wikipedia", "facebook",
    "yelp", "tripadvisor"]
CIVIC_HOST_PARTS = [
    "county", "city", "township", "village", "parish", "borough", "municip", "cityof",
    "townof", "countyof"]
CIVIC_COM_PARTS = ["cityof", "townof", "countyof", "ci.", "co."]
NAME_TAIL_WORDS = ["county", "parish", "borough", "township", "village", "city", "town"]
KIND_WORD = {"county": "county", "place": "city", "mcd": "township", "state": "state",
             "school": "school district"}

# -- search wording (fixed values): {name} {state} {cat} {kind} -------------
QUERY_TEMPLATES = {
    "framework": [
        "{state} state code local sales tax authority maximum rate",
        "{state} statute two-thirds vote local tax measure",
        "{state} constitution property tax levy limit local government",
        "{state} secretary of state local ballot measure requirements",
        "{state} code lodging tax county municipality maximum",
        "{state} legislature revenue title local option taxes"],
    "elections": [
        '"{name}" {state} board of elections official results canvass',
        '"{name}" {state} election results levy bond measure',
        '"{name}" {state} abstract of votes filetype:pdf',
        '"{name}" {state} county clerk elections past results',
        '"{name}" {state} ballot measure results site:.gov'],
    "*": [
        '"{name}" {state} {kind} official website',
        "{name} {state} {cat} tax rate",
        '"{name}" {state} {cat} tax filetype:pdf',
        "{name} {state} treasurer auditor {cat}",
        "{name} {state} {cat} tax site:.gov"],
}
MAX_QUERIES_PER_ROUND = 8

# -- model prices: $ per million tokens in, out (fixed values) --------------
CACHE_WRITE_FACTOR = 1.25
CACHE_READ_FACTOR = 0.10
FALLBACK_PRICE = (5.0, 25.0)

# -- cross references in rate tables (fixed value) --------------------------
SEE_ELSEWHERE_PATTERN = r"(?i)(?:^|[\n*•|(\[]|[-—–])\s*see\s+\S"
EXCERPT_SEPARATOR = "\n\n[... document trimmed to the passages around each finding ...]\n\n"
PAGE_SEPARATOR = "\n\n-----\n\n"
TRUNCATION_MARK = "\n\n[truncated]"

#: Tags whose text is no page content, and tags without an end tag.
DROPPED_TAGS = ["script", "style", "noscript", "svg", "iframe", "nav", "footer", "header", "form", "aside", "button"]
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
