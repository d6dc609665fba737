"""Fixed values of the triage domain. Results depend on them, so they stand here plainly, once."""

# Solicitation kinds, project types and further closed vocabularies.
KINDS = ["itb", "rfb", "addendum", "date_change", "reminder", "prebid_notice", "rfi_response", "award", "platform_noise", "not_bid"]
SOLICITATIONS = ["itb", "rfb"]
DATE_MOVERS = ["addendum", "date_change", "itb", "prebid_notice", "rfb"]
STATUSES = ["new", "undecided", "snoozed", "bidding", "passed", "submitted", "won", "lost", "cancelled", "archived"]
DECIDED = ["bidding", "passed", "submitted", "won", "lost", "cancelled"]
BANDS = ["bid", "consider", "likely_pass", "pass"]

# Which status may follow which.
TRANSITIONS = {
    "new": ["archived", "bidding", "cancelled", "lost", "passed", "snoozed", "undecided"],
    "undecided": ["archived", "bidding", "cancelled", "lost", "passed", "snoozed"],
    "snoozed": ["archived", "bidding", "cancelled", "lost", "passed", "undecided"],
    "bidding": ["archived", "cancelled", "lost", "passed", "submitted", "undecided"],
    "passed": ["archived", "bidding", "cancelled", "lost", "undecided"],
    "submitted": ["archived", "bidding", "cancelled", "lost", "won"],
    "won": ["archived", "cancelled", "lost", "submitted"],
    "lost": ["archived", "cancelled", "submitted", "won"],
    "cancelled": ["archived", "undecided"],
    "archived": ["bidding", "cancelled", "undecided"],
}
ACTION_STATUS = {
    "bid": "bidding", "pass": "passed", "snooze": "snoozed", "submit": "submitted", "won": "won", "lost": "lost", "cancel": "cancelled",
    "archive": "archived", "reopen": "undecided",
}
PASS_REASONS = ["gc", "no_capacity", "open_shop", "other", "too_big", "too_far", "too_small", "wrong_type"]

NAME_STOPWORDS = [
    "a", "an", "and", "at", "bid", "bldg", "building", "electrical", "fit", "fit-out", "fitout", "for", "improvement", "improvements", "invitation",
    "itb", "new", "of", "out", "package", "phase", "project", "re-bid", "rebid", "renovation", "renovations", "rfp", "tenant", "the", "ti", "to",
]
NUMBER_WORDS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6"}
GC_SUFFIXES = ["inc", "incorporated", "llc", "lp", "l p", "co", "company", "corp", "corporation", "construction", "builders", "contractors", "group"]
GENERIC_DOMAINS = ["aol.com", "comcast.net", "gmail.com", "hotmail.com", "icloud.com", "live.com", "msn.com", "outlook.com", "verizon.net", "yahoo.com"]
PLATFORM_DOMAINS = [
    "bidmail.com", "buildingconnected.com", "constructconnect.com", "construction.com", "downtobid.com", "isqft.com", "panteratools.com",
    "planhub.com", "procore.com", "procoretech.com", "smartbid.co", "smartbidnet.com",
]
PLATFORM_NAMES = [
    "bid mail", "bidmail", "building connected", "buildingconnected", "constructconnect", "dodge", "dodge construction network", "downtobid",
    "isqft", "pantera", "pantera tools", "planhub", "procore", "smartbid", "smartbidnet",
]
HOST_CLASSES = {
    "buildingconnected.com": "buildingconnected", "procore.com": "procore", "isqft.com": "isqft", "constructconnect.com": "isqft",
    "planhub.com": "planhub", "smartbidnet.com": "smartbid", "smartbid.co": "smartbid", "panteratools.com": "pantera", "dropbox.com": "dropbox",
    "box.com": "box", "sharefile.com": "sharefile", "egnyte.com": "egnyte", "sharepoint.com": "onedrive", "onedrive.live.com": "onedrive",
    "1drv.ms": "onedrive", "drive.google.com": "google_drive", "docs.google.com": "google_drive", "pennbid.net": "public_portal",
    "bidnetdirect.com": "public_portal",
}
LINK_WRAPPERS = ["safelinks.protection.outlook.com", "sendgrid.net", "mailchimp", "list-manage.com", "click.", "links.", "urldefense"]

# The default profile's tables.
TYPE_FACTOR = {
    "higher_education": 1.0, "healthcare": 0.95, "commercial_office": 0.9, "high_tech_research_data_center": 0.9, "religious": 0.85,
    "light_industrial_utility": 0.8, "multifamily_hotel_mixed_use": 0.6, "k12_education": 0.6, "government_civic": 0.6, "retail_restaurant": 0.5,
    "parking_transportation": 0.4, "heavy_industrial": 0.2, "site_civil_only": 0.1, "residential_single_family": 0.0, "other": 0.4, "unknown": 0.5,
}
ELECTRICAL_SHARE = {
    "high_tech_research_data_center": 0.22, "healthcare": 0.15, "higher_education": 0.13, "commercial_office": 0.11, "k12_education": 0.11,
    "religious": 0.1, "light_industrial_utility": 0.1, "heavy_industrial": 0.12, "multifamily_hotel_mixed_use": 0.08, "retail_restaurant": 0.08,
    "government_civic": 0.11, "parking_transportation": 0.07, "site_civil_only": 0.05, "residential_single_family": 0.06, "other": 0.1, "unknown": 0.1,
}
COST_PER_SF = {
    "high_tech_research_data_center": 900.0, "healthcare": 600.0, "higher_education": 500.0, "commercial_office": 350.0, "k12_education": 400.0,
    "religious": 350.0, "light_industrial_utility": 200.0, "heavy_industrial": 300.0, "multifamily_hotel_mixed_use": 300.0,
    "retail_restaurant": 250.0, "government_civic": 450.0, "parking_transportation": 80.0, "site_civil_only": 50.0,
    "residential_single_family": 200.0, "other": 300.0, "unknown": 300.0,
}
GC_TIER = {"A": 1.0, "B": 0.8, "C": 0.5, "D": 0.2, "blocked": 0.0, "unknown": 0.5}
BID_TYPE = {
    "negotiated": 1.0, "design_assist": 1.0, "design_build": 0.9, "gmp": 0.7, "budget": 0.7, "hard_bid_private": 0.7, "hard_bid_public": 0.6,
    "unknown": 0.7,
}

# Resolution thresholds.
AUTO_MERGE, REVIEW, REBID_DAYS, NAME_FLOOR, RELATED, TRIGRAM = 0.9, 0.6, 45, 0.5, 0.85, 0.25
CANDIDATES = 400
SHOP = (40.3462, -79.9482)

# Patterns of the rules on texts; fixed values, without regard to case.
NOISE_SUBJECT = r"(unsubscribe|newsletter|webinar|your (weekly|daily) digest|password reset|invoice #|statement of account|out of office|automatic reply)"
BID_HINT = (
    r"(invitation to bid|invited to bid|bid (due|date|package|form|invite)|request for (proposal|budget|quote|qualifications)|\bitb\b|\brfp\b|\brfq\b|addend|"
    r"pre-?bid|bid opening|scope of work|proposal due)"
)
REMOVAL = (
    r"\b(remove[sd]?|removal|delete[sd]?|deletion|descope[sd]?|de-scope[sd]?|omit(?:s|ted)?|no longer (?:included|in scope|part of)|strike[sn]?|excluded from this bid)\b"
)
CANCELLED = (
    r"\b(cancel(?:led|ed|lation|ation)?|withdraw(?:n|al)?|(?:project|bid|solicitation)\s+(?:is\s+)?(?:on\s+hold|shelved|postponed indefinitely)|not (?:going|moving) forward)\b"
)
LOST = (
    r"\b(awarded to (?:another|a different|other)|another (?:firm|contractor|bidder)|unsuccessful|were not (?:the )?(?:successful|low)|not been selected|regret to inform|"
    r"thank you for bidding|decided to (?:go|proceed) with another)\b"
)
WON = r"\b(pleased to (?:award|inform)|you (?:have been|are being) awarded|(?:intent|letter) of intent to award(?: to you)?|congratulations[, ].{0,40}\baward)\b"
QUOTE_MARKS = [r"\n\s*-{2,}\s*Original Message\s*-{2,}", r"\nOn .{5,120} wrote:\s*\n", r"\nFrom:\s.*\nSent:\s.*\n", r"\n_{5,}\n"]
PLATFORM_IDS = [
    ("bc", r"buildingconnected\.com/(?:projects|bids|rfp)/([0-9a-f]{12,})"),
    ("procore", r"procore\.com/\d+/(?:[\w-]+/)*?(?:bid_packages|packages|projects)/(\d+)"),
    ("pkg", r"[?&]bid_?package_?id=([\w-]+)"),
    ("proj", r"[?&](?:projectid|project_id)=([\w-]+)"),
]
BODY_SCAN, FILE_SCAN = 2_000, 3_000  # characters that the pre-filter looks at
DIGEST_FLAGS = [
    "prevailing_wage", "davis_bacon", "bid_bond", "pp_bond", "mandatory_prebid", "open_shop_indicated", "sealed_bid", "date_conflict", "possible_duplicate", "orphan_update",
    "locked_conflict", "removed_by_addendum", "snooze_overridden", "reactivated", "outcome_conflict",
]
FEED_STATUSES = ["bidding", "undecided", "submitted", "passed", "lost", "cancelled"]
