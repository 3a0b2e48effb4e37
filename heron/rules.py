"""Rule packs: defaults that callers replace by their own. All operators take them as parameters."""

from __future__ import annotations

# Word lists, patterns and ladders that results depend on, in their natural order.

TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "ref", "source", "_ga"]
SKIP_EXTENSIONS = [".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".css", ".js", ".woff", ".woff2", ".ttf", ".ico", ".mp4", ".mp3", ".zip", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx"]
SKIP_PATTERNS = ["/login", "/logout", "/auth", "/oauth", r"\?.*redirect", r"/search\?"]
PAGE_TYPES = {
    "home": ["^/$", "^/index", "^/?$"],
    "service": ["/service", "/solution", "/shipping", "/freight", "/transport", "/mode"],
    "about": ["/about", "/company", "/who-we-are", "/our-story", "/history", "/leadership"],
    "careers": ["/career", "/job", "/hiring", "/driver", "/employment", "/work-with-us"],
    "contact": ["/contact", "/location", "/find-us", "/get-in-touch"],
    "news": ["/news", "/press", "/media", "/blog", "/article", "/insights"],
    "investor": ["/investor", "/shareholder", "/financial", "/sec-filing", "/stock"],
    "technology": ["/tech", "/platform", "/digital", "/innovation", "/360", "/tools"],
    "sustainability": ["/sustain", "/environment", "/esg", "/green", "/carbon"],
    "customer_portal": ["/login", "/portal", "/my-account", "/track", "/quote"],
    "carrier": ["/carrier", "/owner-operator", "/partner"],
}
PRIORITIES = {
    "high": ["/service", "/solution", "/freight", "/shipping", "/transport", "/carrier", "/shipper", "/tracking", "/intermodal", "/truckload", "/ltl", "/drayage", "/dedicated", "/brokerage", "/logistics", "/technology", "/platform", "/api"],
    "medium": ["/resource", "/blog", "/news", "/case-study", "/about", "/company", "/contact"],
    "low": ["/privacy", "/terms", "/accessibility", "/cookie", "/legal", "/sitemap", "/careers", "/job", "/investor"],
}
EXPECTED_SECTIONS = ["solutions", "carriers", "technology", "resources", "about"]
TERMS = [
    "ai", "artificial intelligence", "machine learning", "automation", "digital", "platform", "technology", "visibility", "real-time", "analytics",
    "api", "integration", "iot", "intermodal", "truckload", "ltl", "drayage", "last mile", "final mile", "dedicated", "brokerage", "3pl",
    "supply chain", "logistics", "sustainability", "carbon", "emissions", "green", "safety", "reliable", "on-time", "capacity", "network",
    "partner", "solution", "nationwide", "north america", "global",
]
NAV_STRIP = [r"^our\s+", r"^the\s+", r"^all\s+", r"^view\s+(all\s+)?", r"^explore\s+", r"^discover\s+", r"\s+us$", r"\s+overview$", r"\s+home$"]
NAV_SYNONYMS = {
    "about": ["about", "company", "who we are", "our story", "why"],
    "services": ["services", "what we do", "our services", "capabilities", "freight", "shipping", "transportation"],
    "solutions": ["solutions", "offerings", "what we offer", "freight-shipping"],
    "products": ["products", "our products", "product line"],
    "resources": ["resources", "insights", "knowledge", "learn", "tools", "calculators"],
    "contact": ["contact", "get in touch", "reach us", "connect"],
    "careers": ["careers", "jobs", "work with us", "join us", "employment", "drive for us"],
    "news": ["news", "newsroom", "press", "media", "announcements", "market updates"],
    "investors": ["investors", "investor relations", "ir", "shareholders"],
    "support": ["support", "help", "customer service", "faq"],
    "developers": ["developers", "developer", "dev", "api", "documentation", "docs"],
    "carriers": ["carriers", "haul with us", "owner operators", "drive for", "partner carriers"],
    "shippers": ["shippers", "ship with us", "customers", "freight shipping"],
    "technology": ["technology", "tech", "platform", "digital", "freightpower"],
}
MONEY = [
    (r"\$[\d,]+(?:\.\d{2})?(?:\s*(?:k|K|thousand|million|M))?\b", "dollar"),
    (r"[\d.]+\s*(?:cents?|¢)\s*(?:per\s+)?(?:mile|mi)\b", "per_mile"),
    (r"\$[\d.]+\s*/\s*(?:mile|mi)\b", "per_mile"),
    (r"[\d.]+\s*(?:cpm|CPM)\b", "per_mile"),
    (r"\$[\d.]+\s*(?:/\s*hr|/\s*hour|per\s+hour)\b", "per_hour"),
    (r"\d+(?:\.\d+)?\s*%", "percent"),
]
MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
DATES = [rf"\b(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\b\d{4}-\d{2}-\d{2}\b", r"\b(?:Q[1-4]|first|second|third|fourth)\s+(?:quarter|qtr)(?:\s+\d{4})?\b"]
STATES = [
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "Florida", "Georgia",
    "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine", "Maryland",
    "Massachusetts", "Michigan", "Minnesota", "Mississippi", "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey",
    "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon", "Pennsylvania", "Rhode Island", "South Carolina",
    "South Dakota", "Tennessee", "Texas", "Utah", "Vermont", "Virginia", "Washington", "West Virginia", "Wisconsin", "Wyoming",
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO",
    "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
]
NOT_STATES = ["in", "or", "me", "hi", "oh", "ok", "co", "de", "la", "ma", "md", "mo", "ne", "pa"]
COMPENSATION = {
    "sign_on_bonus": ["sign-on", "sign on", "signing bonus", "welcome bonus", "hiring bonus"],
    "pay_per_mile": ["cpm", "cents per mile", "per mile", "/mile", "mileage pay"],
    "hourly": ["per hour", "/hour", "hourly", "/hr"],
    "benefits": ["401k", "401(k)", "health insurance", "medical", "dental", "vision", "pto", "paid time off", "vacation"],
    "home_time": ["home time", "home weekly", "home daily", "weekends off", "regional"],
    "equipment": ["new equipment", "new trucks", "late model", "assigned truck"],
    "quick_pay": ["quick pay", "fast pay", "same day pay", "instant pay", "daily pay"],
    "fuel": ["fuel discount", "fuel card", "fuel surcharge", "fuel bonus"],
    "training": ["cdl training", "paid training", "tuition", "cdl school"],
    "lease": ["lease purchase", "lease-to-own", "lease program", "owner operator"],
}
URGENCY = [r"hiring\s+(?:\w+\s+)?immediately", "urgent(?:ly)?", r"hiring\s+now", r"immediate\s+openings?", r"spots?\s+available", r"limited\s+positions?", r"apply\s+today", r"start\s+(?:this|next)\s+week", r"high\s+demand", r"critical\s+need", r"now\s+hiring", r"immediate(?:ly)?\s+(?:hiring|need)"]
POSITIVE = ["best", "great", "excellent", "top", "leading", "premier", "award", "guaranteed", "reliable", "trusted", "professional", "dedicated", "competitive", "generous", "comprehensive", "flexible", "modern"]
NEGATIVE = ["required", "must", "mandatory", "minimum", "only", "limited", "subject to", "restrictions", "fees", "deductions", "penalty"]
CONTEXT_FOR = ["driver", "trucker", "cdl", "otr", "regional", "local", "pay", "earn", "make", "salary", "compensation", "wage", "bonus", "benefit", "sign-on", "signing", "retention", "per mile", "cpm", "per hour", "hourly", "weekly", "annual", "home time", "guaranteed", "average", "top", "owner operator", "lease", "settlement", "revenue"]
CONTEXT_AGAINST = ["revenue", "profit", "stock", "share", "investor", "market cap", "cost", "expense", "price", "fee", "charge", "liability", "loan", "debt", "mortgage", "financing", "credit", "shipping cost", "freight rate", "quote", "estimate", "donation", "charity", "foundation", "grant"]
AUDIENCES = {
    "drivers": ["cdl", "driver", "trucker", "otr", "regional driver", "local driver", "company driver"],
    "owner_operators": ["owner operator", "o/o", "lease purchase", "independent contractor", "settlement", "your truck"],
    "carriers": ["carrier", "fleet", "trucking company", "motor carrier", "partner with us", "haul for us"],
    "shippers": ["shipper", "ship with us", "get a quote", "freight", "logistics solution", "supply chain"],
}
BOILERPLATE = ["enable javascript", "javascript is required", "please enable cookies", "access denied", "403 forbidden", "404 not found", "page not found", "sorry, you have been blocked", "checking your browser", "just a moment", "attention required"]
CHALLENGES = ["checking your browser", "checking the site connection security", "just a moment", "please wait", "ddos protection", "cf-browser-verification", "captcha", "sg-captcha", "verify you are human", "security check required", "one more step", "ray id", "performance & security by cloudflare", "attention required", "enable javascript and cookies to continue"]
SOFT_BLOCKS = ["access denied", "your request has been blocked", "request blocked", "forbidden", "security check", "unusual traffic", "too many requests", "rate limit", "automated access", "bot detected", "suspected automated", "please verify"]
CAPTURE_CHALLENGES = ["checking your browser", "checking the site connection security", "just a moment", "cf-browser-verification", "captcha", "sg-captcha", "challenge"]
CAPTURE_BLOCKS = ["your request has been blocked", "request has been blocked", "request blocked", "access denied", "forbidden", "unusual traffic", "automated process", "security check", "bot detected"]
LADDER = ["requests", "js", "stealth", "stealth_patient", "visible"]
PORTALS = {
    "customer_portal": ["/customer", "/shipper", "/my-?account", "/client"],
    "carrier_portal": ["/carrier", "/owner-?operator", "/driver", "/partner"],
    "tracking": ["/track", "/trace", "/shipment", "/pro-?search"],
    "quote": ["/quote", "/rate", "/pricing", "/estimate"],
    "login": ["/login", "/sign-?in", "/auth", "/sso", "/portal"],
    "investor": ["/investor", "/shareholder", "/sec-?filing"],
}
OAUTH = {"Google OAuth": r"sign\s*in\s*with\s*google", "Microsoft OAuth": r"sign\s*in\s*with\s*microsoft", "Okta SSO": r"sign\s*in\s*with\s*okta", "Azure AD": r"sign\s*in\s*with\s*azure", "SSO": r"saml|sso|single\s*sign"}
INTEGRATIONS = {
    "Salesforce": "salesforce", "Oracle Transportation": "oracle.*transport", "SAP TM": "sap.*tm|sap.*transport", "E2open/BluJay": "bluejay|e2open", "McLeod Software": "mcleod",
    "Trimble TMW": "tmw|trimble", "MercuryGate": "mercurygate", "project44": "project44|p44", "FourKites": "fourkites", "Descartes": "descartes",
    "Manhattan Associates": "manhattan.*associates", "Blue Yonder": r"jda|blue\s*yonder", "EDI": "edi.*integration|x12|edifact", "API Integration": "api.*integration|rest.*api|api.*access",
}
SPA_ROOTS = {name: rf"<div\s+id=[\"']{name}[\"']\s*>\s*</div>" for name in ("root", "app", "__next", "__nuxt", "main-app", "application")}
FRAMEWORKS = {
    "next.js": ["__NEXT_DATA__", "_next/static", "next/dist", r"<meta\s+name=[\"']generator[\"']\s+content=[\"']Next\.js"],
    "nuxt": ["__NUXT__", "_nuxt/", r"nuxt\.js"],
    "react": [r"react\.production\.min\.js", "react-dom", "data-reactroot", "data-reactid"],
    "vue": [r"vue\.runtime", r"vue\.min\.js", "data-v-[a-f0-9]+", "v-cloak"],
    "angular": ["ng-version", r"angular\.min\.js", "ng-app", "<app-root"],
    "svelte": ["svelte", "__svelte"],
    "aem": [r"/etc\.clientlibs/", "/_jcr_content/", "/content/dam/", "/content/experience-fragments/", "cq:cloudserviceconfigs", "data-cmp-", "aemanalytics", "granite/ui"],
}
HYDRATION = [r"window\.__INITIAL_STATE__", r"window\.__PRELOADED_STATE__", r"window\.__APP_STATE__", r"hydrate\(", r"createRoot\(", r"ReactDOM\.render"]
NOSCRIPT = ["<noscript>.*?(?:enable|requires?|need).*?javascript.*?</noscript>", "<noscript>.*?(?:browser|support).*?javascript.*?</noscript>"]
BUNDLES = [r"src=[\"'][^\"']*(?:bundle|main|app|vendor|chunk)\.[a-f0-9]+\.js", r"src=[\"'][^\"']*webpack", r"src=[\"'][^\"']*\.chunk\.js"]
# Marks of what a page offers, and of where its text is, the first that occurs.
PAGE_SIGNS = {
    "login": ["/login", "/signin", "/sign-in", "/auth", "/account", "/portal", "/my-account", "/customer", r"<input\b[^>]*\btype\s*=\s*[\"']password[\"']"],
    "search": ["/search", "search-results", "q=", r"<input\b[^>]*\btype\s*=\s*[\"']search[\"']", r"<form\b[^>]*\brole\s*=\s*[\"']search[\"']"],
    "cookie_banner": ["cookie-consent", "cookie-banner", "cookie-notice", "cookie-policy", "gdpr", "cc-window", "cc-banner", "onetrust", "cookiebot", "privacy-banner", "consent-banner", "accept-cookies"],
    "lazy_images": ["lazyload", "lazy-load", r"<[^>]*\sdata-src\s*=", r"<img\b[^>]*\bloading\s*=\s*[\"']lazy[\"']"],
    "endless": ["infinite.?scroll", "load.?more", "pagination"],
}
MAIN_MARKS = {
    "main": r"<main\b",
    "article": r"<article\b",
    '[role="main"]': r"<[^>]*\brole\s*=\s*[\"']main[\"']",
    "#content": r"<[^>]*\bid\s*=\s*[\"']content[\"']",
    ".content": r"<[^>]*\bclass\s*=\s*[\"']([^\"']*\s)?content(\s[^\"']*)?[\"']",
    "#main": r"<[^>]*\bid\s*=\s*[\"']main[\"']",
}
TECHNOLOGIES = {
    "react": ["react", "_react", "__NEXT_DATA__", "data-reactroot"], "vue": ["vue", "__vue__", "data-v-[a-f0-9]"], "angular": ["ng-version", "ng-app", "angular", "<app-root"],
    "next.js": ["__NEXT_DATA__", "_next/static"], "nuxt": ["__NUXT__", "_nuxt/"], "wordpress": ["wp-content", "wp-includes", "wordpress"], "drupal": ["drupal", "/sites/default/"],
    "shopify": ["shopify", "cdn.shopify"], "squarespace": ["squarespace", "static1.squarespace"], "wix": ["wix.com", "parastorage.com"], "hubspot": ["hubspot", "hs-scripts", "hbspt"],
    "gtm": ["googletagmanager", "gtm.js"], "ga4": ["gtag", "google-analytics", "analytics.js"], "hotjar": ["hotjar", "static.hotjar.com"], "aem": ["/etc.clientlibs/", "/content/dam/", "aem"], "sitecore": ["sitecore", "/sitecore/"],
}
HINTS = {
    "portal": (["/portal", "/login", "/carrier", "/shipper", "/customer"], [r"carrier\s+portal", r"shipper\s+portal", r"customer\s+portal", r"my\s+account"], "high", 1),
    "tracking": (["/track", "/shipment", "/tracing"], [r"track\s+(your\s+)?shipment", r"shipment\s+tracking", r"tracking\s+number"], "high", 1),
    "api_docs": (["/api", "/developer", "/docs", "/documentation", "/sdk"], [r"api\s+documentation", r"developer\s+portal", r"rest\s+api", "sdk"], "high", 2),
    "edi": (["/edi", "/integration"], [r"edi\s+integration", r"electronic\s+data\s+interchange"], "medium", 1),
    "tms": (["/tms", "/logistics"], [r"transportation\s+management", r"tms\s+integration", r"logistics\s+platform"], "medium", 1),
    "pricing": (["/pricing", "/rates", "/quote"], [r"get\s+a?\s*quote", r"request\s+pricing", r"rate\s+calculator"], "medium", 0),
}
PAY_STRONG = ["/careers?(?:/|$)", "/jobs?(?:/|$)", "/owner-?operators?", "/recruiting", "/employment", "/apply(?:/|$)", "/benefits(?:/|$)", "/pay(?:/|$)", "/compensation", "/join(?:-us|-our-team)?(?:/|$)", "/work-?(with|for|at)-us", "/driver-?(?:jobs|careers|pay|benefits|application)"]
PAY_WEAK = ["/drivers?(?:/|$)", "/driving(?:/|$)"]
PAY_EXCLUDED = ["/blog/", "/news/", "/press/", "/article/", "/driving-change", "/driving-towards"]
PAY_TYPES = ["careers", "recruiting", "drivers", "benefits"]
DECORATIVE = ["spacer", "pixel", "blank", "transparent", "1x1", "sprite", "icon-", "-icon"]
IMAGE_KINDS = {"logo": ["logo", "brand", "wordmark"], "icon": ["icon", "ico-", "-ico", "favicon", "sprite"], "diagram": ["diagram", "chart", "graph", "flow", "architecture"], "screenshot": ["screenshot", "screen-", "capture", "preview"]}

# Packs of our own that fit the synthetic tables, where the packs above match next to nothing.

SYNTHETIC_TERMS = ["the", "of", "and", "der", "die", "que", "de", "la", "les", "apache license"]
SYNTHETIC_PAGE_TYPES = {"home": ["^/$", "^/?$"], "english": ["^/en/"], "french": ["^/fr/"], "german": ["^/de/"], "spanish": ["^/es/"]}
