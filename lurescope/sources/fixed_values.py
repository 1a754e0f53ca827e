"""Fixed values.

Everything in this module is a constant that must equal the detection rules we
reproduce, or the scores change: the brand keyword dictionary, the TLD risk
table, the look-alike character map, the action words, the WHOIS privacy terms,
the rule-score words and the thresholds.  They are listed plainly and in their
natural order.  Nothing else in the package hard-codes them.
"""

# --- fixed values: brand -> keywords (63 brands, 85 keywords) -------------
BRAND_KEYWORDS: dict[str, list[str]] = {
    "SBI": ["sbi", "statebankofindia", "onlinesbi"],
    "HDFC": ["hdfc", "hdfcbank"],
    "ICICI": ["icici", "icicibank"],
    "Axis Bank": ["axisbank", "axisbk"],
    "PNB": ["pnb", "punjabnationalbank"],
    "Bank of Baroda": ["bankofbaroda", "bobibanking"],
    "Canara Bank": ["canarabank"],
    "Union Bank": ["unionbankofindia"],
    "Kotak Mahindra": ["kotak", "kotakbank"],
    "IndusInd Bank": ["indusind"],
    "Yes Bank": ["yesbank"],
    "IDBI Bank": ["idbibank"],
    "IDFC First": ["idfcfirst"],
    "Federal Bank": ["federalbank"],
    "RBL Bank": ["rblbank"],
    "UPI": ["upi", "bhimupi", "bhim"],
    "PhonePe": ["phonepe"],
    "Google Pay": ["googlepay", "gpay"],
    "Paytm": ["paytm"],
    "Amazon Pay": ["amazonpay"],
    "NPCI": ["npci"],
    "RBI": ["reservebankofindia", "rbiindia"],
    "SEBI": ["sebi"],
    "IRCTC": ["irctc"],
    "Income Tax Dept": ["incometax", "incometaxindia"],
    "GST": ["gstn", "gstportal"],
    "Aadhaar": ["aadhaar", "aadhar", "uidai"],
    "PAN Card": ["pancard", "nsdl"],
    "DigiLocker": ["digilocker"],
    "MyGov": ["mygov"],
    "PM Kisan": ["pmkisan"],
    "EPFO": ["epfo"],
    "Passport Seva": ["passportindia", "passportseva"],
    "GOV": ["govtindia", "government"],
    "LIC": ["licindia"],
    "Airtel": ["airtel", "airtelpayments"],
    "Jio": ["myjio", "jiomoney"],
    "Vi": ["vodafoneidea"],
    "BSNL": ["bsnl"],
    "Flipkart": ["flipkart"],
    "Amazon India": ["amazonin"],
    "Myntra": ["myntra"],
    "Snapdeal": ["snapdeal"],
    "Zomato": ["zomato"],
    "Swiggy": ["swiggy"],
    "MakeMyTrip": ["makemytrip"],
    "OYO": ["oyorooms"],
    "Ola": ["olacabs"],
    "Uber India": ["uberindia"],
    "BigBasket": ["bigbasket"],
    "PolicyBazaar": ["policybazaar"],
    "Groww": ["groww"],
    "Zerodha": ["zerodha", "kite"],
    "Upstox": ["upstox"],
    "CoinDCX": ["coindcx"],
    "WazirX": ["wazirx"],
    "HDFC Life": ["hdfclife"],
    "ICICI Prudential": ["iciciprudential"],
    "Star Health": ["starhealth"],
    "Tata AIG": ["tataaig"],
    "Bajaj Finserv": ["bajajfinserv"],
    "Muthoot Finance": ["muthoot"],
    "SBI Card": ["sbicard"],
}

# --- fixed values: TLD suffix -> risk (43 suffixes) -----------------------
TLD_RISK: dict[str, float] = {
    "gov.in": 0.01,
    "nic.in": 0.01,
    "mil": 0.01,
    "ac.in": 0.02,
    "res.in": 0.02,
    "edu": 0.02,
    "edu.in": 0.02,
    "gov": 0.03,
    "org.in": 0.08,
    "org": 0.10,
    "co.in": 0.15,
    "com": 0.15,
    "in": 0.20,
    "net": 0.22,
    "co": 0.30,
    "io": 0.28,
    "app": 0.35,
    "shop": 0.55,
    "info": 0.55,
    "biz": 0.50,
    "online": 0.65,
    "site": 0.70,
    "website": 0.68,
    "live": 0.60,
    "click": 0.88,
    "link": 0.85,
    "top": 0.90,
    "xyz": 0.94,
    "tk": 0.96,
    "ml": 0.93,
    "ga": 0.92,
    "cf": 0.93,
    "gq": 0.91,
    "work": 0.75,
    "support": 0.80,
    "loan": 0.85,
    "win": 0.87,
    "bid": 0.86,
    "party": 0.89,
    "review": 0.72,
    "download": 0.83,
    "stream": 0.79,
    "icu": 0.90,
}
UNKNOWN_TLD_RISK = 0.5

# --- fixed values: look-alike character -> ASCII letter (24 entries) ------
CONFUSABLES: dict[str, str] = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ѡ": "w", "ᴠ": "v",
    "ⅼ": "l", "ⅰ": "i", "０": "0", "１": "1",
    "α": "a", "ο": "o", "ν": "v", "κ": "k", "β": "b", "ρ": "p",
}

# --- fixed values: phishing action words (21) -----------------------------
ACTION_WORDS: list[str] = [
    "login", "secure", "verify", "update", "account", "confirm", "support",
    "service", "alert", "suspend", "kyc", "otp", "reward", "offer", "bonus",
    "free", "claim", "bank", "signin", "password", "reset",
]

# --- fixed values: brand scoring weights ----------------------------------
KEYWORD_HIT_WEIGHT = 0.25
ACTION_WORD_BOOST = 0.15
MAX_TYPOSQUAT_DISTANCE = 2
MIN_TYPOSQUAT_TOKEN_LENGTH = 3

# --- fixed values: WHOIS ----------------------------------------------------
WHOIS_PRIVACY_TERMS: list[str] = ["privacy", "redacted", "whoisguard", "proxy"]
RECENTLY_REGISTERED_DAYS = 30

# --- fixed values: request rule score and verdict bands -------------------
RULE_SCORE_WORDS: list[str] = ["sbi", "hdfc", "upi", "verify", "secure", "login", "bank"]
RULE_SCORE_HIT = 85
RULE_SCORE_MISS = 12
HIGH_RISK_THRESHOLD = 70
MEDIUM_RISK_THRESHOLD = 40
MAX_URL_LENGTH = 500

# --- fixed values: feed paging and report -----------------------------------
FEED_DEFAULT_LIMIT = 50
FEED_MAX_LIMIT = 200
INCIDENT_ID_PREFIX = "IR-2024-PH-"
REPORT_STATUS = "report_generation_available_in_phase5"
CERT_ALERTS_COUNT = 0
