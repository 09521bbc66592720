"""Word lists and patterns of the text rules. They must equal the rules' own for equal results."""

THEMES = ["PLI scheme", "Make in India", "production linked incentive", "China+1", "import substitution", "defence indigenisation", "Atmanirbhar", "railway capex", "renewable energy", "green hydrogen", "semiconductor mission", "PM Gati Shakti", "electronics manufacturing", "EV policy", "FAME scheme", "housing for all", "infrastructure pipeline", "data centre", "smart meter", "transmission capex", "shipbuilding"]
EVENTS = ["order win", "bags order", "order worth", "wins contract", "contract from", "letter of intent", "capacity expansion", "new plant", "commissions", "commercial production", "capex", "acquisition", "acquires", "stake", "guidance", "raises target", "target price", "upgrade", "record revenue", "profit jumps", "profit surges", "turns profitable", "fund raise", "qip", "preferential issue", "buyback", "bonus issue", "export order", "approval", "patent", "launch"]
RESULTS = ["board meeting", "financial results", "quarterly results", "audited results", "unaudited results", "outcome of board", "consider and approve", "results for the quarter"]
RED_FLAGS = ["sebi", "fraud", "probe", "investigation", "raid", "default", "auditor resigns", "auditor resignation", "insolvency", "nclt", "pledge invoked", "downgrade", "show cause", "penalty", "fine", "whistleblower", "delisting", "suspended", "scam"]
TRUSTED = ["economic times", "economictimes", "moneycontrol", "business standard", "livemint", "mint", "reuters", "bloomberg", "cnbc", "business today", "financial express", "ndtv profit", "businessline", "zee business", "the hindu", "business upturn", "upstox", "trendlyne", "scanx", "marketscreener", "tradingview", "equitybulls", "capital market"]
GENERIC = ["limited", "ltd", "india", "indian", "industries", "industry", "corporation", "company", "enterprises", "international", "projects", "products", "solutions", "systems", "services", "technologies", "technology", "tech", "and", "the", "of"]
UP = ["order win", "bags", "wins", "surge", "jumps", "rallies", "rallied", "record", "expansion", "approval", "upgrade", "raises", "profit rises", "profit jumps", "profit up", "beats", "strong", "buyback", "bonus", "highest", "all-time high", "turnaround", "doubles", "soars", "gains", "rises", "rally", "spikes", "zooms", "navratna", "wins order", "secures", "new high", "multibagger", "rerating", "re-rating", "upper circuit", "outperform", "target raised", "order inflow", "contract win", "revenue up"]
DOWN = ["falls", "fell", "drops", "plunges", "plunge", "loss widens", "weak", "downgrade", "cuts", "probe", "penalty", "fraud", "resigns", "default", "declines", "misses", "slumps", "crashes", "under pressure", "sell-off", "warning", "slips", "slides", "slid", "tumbles", "tanks", "tanked", "plummets", "sinks", "sank", "lower circuit", "posts loss", "profit falls", "profit drops", "revenue falls", "underperform", "target cut", "shows cause", "show cause", "pledge", "pledged"]

ROUNDUP = [
    r"\btop gainers\b", r"\btop losers\b", r"\bgainers\s*(&|and)\s*losers\b", r"\bstocks? (to|in) (watch|buy|focus|news)\b", r"\bshares? to buy\b", r"\bstocks? in the news\b", r"\bamong (the )?(top )?(gainers|losers)\b", r"\bthese \d+ (stocks|shares)\b", r"^\d+ (stocks|shares|multibagger)", r"\bbuy or sell\b", r"\bmarket wrap\b",
    r"\b(opening|closing) bell\b", r"\bstock market (today|live|highlights)\b", r"\bmarket live\b", r"\bsensex\b.*\bnifty\b", r"\bmarkets? (open|close)[ds]? (higher|lower|flat)\b", r"\b\d{1,2}\s+(?:\w+\s+){0,2}stocks\b", r"\bmultibaggers\b", r"\b(?:up ?to)\s+\d+(?:\.\d+)?\s*%",
]
NOISE = [
    r"submitted .{0,80}regulation 31", r"\ballotment of securities\b", r"\bemployee stock|\besop\b", r"\brecord date\b", r"\btrading window\b", r"\bbook closure\b", r"newspaper (publication|advertisement)", r"\bshare certificate\b", r"investor (meet|presentation|conference)", r"analyst[s]? (meet|call)", r"(earnings|conference) call", r"\btranscript\b",
    r"regulation 7[45]?\b", r"regulation (13|50|51|6)\b", r"statement of utilization", r"\bsecurity cover\b", r"net asset value|\bnav\b", r"redemption.{0,40}(debenture|ncd|interest)", r"significant (increase in volume|movement in price)", r"sought clarification", r"\bagm\b|\begm\b|annual general meeting|extraordinary general meeting", r"\bpostal ballot\b", r"\bproceedings of\b",
]
MERGER_APPROVAL = r"approval of (merger|scheme|amalgamation)"
#: (polarity, event, patterns), asked in this order.
LADDER = [
    ("neg", "regulatory action", [r"\bsebi (order|probe|penalty|investigation|show cause)", r"\bshow cause notice", r"\bpenalt(y|ies)\b", r"\bprosecution\b", r"\bsearch (and|&) seizure", r"\b(gst|income tax|cbi|enforcement directorate|ed) (raid|search|notice|summons)", r"\braid(s|ed)?\b"]),
    ("neg", "distress", [r"\bdefault(s|ed)?\b", r"\binsolvency\b", r"\bcirp\b", r"\bliquidation\b", r"\bwinding up\b", r"\bfraud\b", r"\bscam\b", r"\bwhistle[- ]?blower", r"\bnclt\b.{0,60}(insolvency|cirp|liquidation|admitted|resolution process)", r"(insolvency|cirp|liquidation).{0,60}\bnclt\b"]),
    ("neg", "pledge", [r"\bpledge[sd]?\b.{0,40}\b(creat|invok|encumb)", r"\binvocation of pledge", r"\brelease of pledge"]),
    ("neg", "management exit", [r"\bresignation of (director|kmp|smp|auditor|cfo|ceo|md\b|managing director|company secretary)", r"\b(auditor|cfo|ceo|managing director)\b.{0,40}\bresign"]),
    ("neg", "rating downgrade", [r"\brating.{0,40}\bdowngrad", r"\bdowngrad.{0,40}\brating"]),
    ("neg", "regulatory letter", [r"\bwarning letter", r"\bform 483\b", r"\bsuspend(ed|s|sion)\b(?!.{0,80}(debenture|ncd))"]),
    ("pos", "order win", [r"\border win", r"\bbags?\b.{0,40}\border", r"\breceives?\b.{0,30}\border", r"\border(s)? (worth|valued|aggregating)\b", r"\bpurchase order\b", r"\bwork order", r"\bexport order", r"\bletter of (intent|award)\b", r"\bwins?\b.{0,30}\b(contract|project|bid)", r"\bcontract (from|worth|of|valued)\b", r"\bsecures?\b.{0,35}\b(order|contract|project)"]),
    ("pos", "expansion", [r"\bcapacity expansion", r"\bnew (plant|facility|manufacturing unit)\b", r"\bcommission(ed|ing)\b", r"\bcommercial (production|operations?)\b", r"\bgreenfield\b", r"\bbrownfield\b"]),
    ("pos", "M&A/JV", [r"\bacquisition\b", r"\bacquires?\b", r"\bamalgamation\b", r"\bmerger\b", r"\bjoint venture\b", r"\bstake (purchase|acquisition|buy)\b", r"\bscheme of arrangement\b", r"\bdivestment\b", r"\bslump sale\b"]),
    ("pos", "approval", [r"\busfda\b", r"\bus fda\b", r"\bfda inspection\b", r"\beir\b", r"\bwho[- ]gmp\b", r"\bgmp certificat", r"\bdcgi\b", r"\bcdsco\b", r"\bpatent (grant|received|approv)", r"\bmarketing authori[sz]ation", r"\bapproval (from|received|granted)\b", r"\breceives? approval\b", r"\btentative approval\b", r"\banda\b"]),
    ("pos", "buyback/bonus", [r"\bbuy[- ]?back\b", r"\bbonus (issue|share)"]),
    ("pos", "rating upgrade", [r"\brating.{0,40}\bupgrad", r"\bupgrad.{0,40}\brating"]),
    ("attn", "fund raise", [r"\bqip\b", r"\brights issue\b", r"\bfund rais", r"\bpreferential issue\b", r"\bissuance of (equity|shares)\b"]),
]
