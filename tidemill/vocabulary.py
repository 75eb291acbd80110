"""Word lists, lookup tables and patterns whose content decides results.

They are plain data, in their natural order, and must not be edited independently of the results
that are expected from them.
"""

# Top-level domains that make a bare host a link, and those often abused.
KNOWN_TLDS = (
    "com net org edu gov mil int info biz name pro io co me tv cc ly gl gd us uk ca au de fr es it nl se no fi dk pl ru ua cn jp kr in sg my ph id th vn hk tw nz za br "
    "mx ar cl pe ie pt gr cz ro hu at ch be tr il ae sa ng ke gh app dev page xyz top icu buzz click link vip shop online site store tech space website fun life world "
    "today email team tk ml ga gq rest deals monster quest cyou sbs cfd bond surf live work fit"
).split()
SUSPICIOUS_TLDS = "top xyz icu buzz click link vip shop online site cc tk ml ga gq rest deals monster quest cyou sbs cfd bond surf live work fit".split()
SHORTENERS = "bit.ly tinyurl.com goo.gl t.co ow.ly is.gd buff.ly cutt.ly rebrand.ly tiny.cc rb.gy shorturl.at bit.do t.ly s.id clck.ru shrtco.de 1url.com tr.im urlz.fr".split()
# Brands compared with the domains of a message.
MISMATCH_BRANDS = "usps fedex ups dhl amazon netflix apple paypal medicare irs walmart costco chase citi wellsfargo bankofamerica att tmobile verizon coinbase ezpass".split()
# Term families; a term is counted wherever it occurs in the lower-cased text.
FAMILIES = {
    "money": ["gift card", "giftcard", "wire transfer", "western union", "money order", "bitcoin", "btc", "crypto", "ethereum", "zelle", "venmo", "cash app", "cashapp", "prepaid card", "paypal me", "moneygram", "steam card", "itunes card", "google play card", "wallet address"],
    "pressure": ["urgent", "urgently", "immediately", "expires", "expiring", "expired", "suspended", "suspension", "final notice", "last chance", "act now", "within 24 hours", "within 48 hours", "24 hrs", "as soon as possible", "asap", "will be closed", "will be terminated", "avoid penalty", "avoid suspension", "limited time", "right away", "before it is too late", "failure to", "must respond"],
    "credentials": ["verification code", "verify your", "confirm your identity", "one-time code", "one time password", "otp", "your pin", "pin number", "password", "card number", "cvv", "social security", "ssn", "date of birth", "account number", "log in", "login", "sign in", "re-activate", "reactivate", "update your details", "confirm your account", "security code"],
    "brands": ["usps", "u.s. postal", "united states postal", "fedex", "ups", "dhl", "royal mail", "canada post", "medicare", "medicaid", "irs", "i.r.s", "internal revenue", "dmv", "social security administration", "e-zpass", "ezpass", "sunpass", "fastrak", "toll", "bank of america", "wells fargo", "chase", "citibank", "citi", "capital one", "usaa", "navy federal", "amazon", "netflix", "apple", "paypal", "walmart", "costco", "at&t", "t-mobile", "verizon", "coinbase", "geek squad", "norton", "mcafee"],
    "optout": ["reply stop", "text stop", "txt stop", "reply help", "text help", "to unsubscribe", "unsubscribe", "opt out", "optout", "stop to end", "stop2end", "msg&data rates", "message and data rates", "std msg rates", "reply stop to cancel"],
    "opener": ["hi grandma", "hi grandpa", "hey grandma", "hello grandma", "hi mom", "hi dad", "is this still your number", "sorry wrong number", "wrong number", "hey it's me", "long time no see", "how are you doing", "do you remember me", "is this ", "i got your number from", "are you free", "new number", "this is my new number"],
}
# The keyword flags.
KEYWORDS = ["http", "www.", "click", "link", "verify", "verification", "account", "suspend", "locked", "urgent", "immediately", "expire", "confirm", "update your", "won", "winner", "prize", "free", "claim", "cash", "gift card", "bank", "card number", "ssn", "social security", "package", "delivery", "usps", "fedex", "irs", "toll", "payment", "refund", "bitcoin", "crypto", "password", "login", "sign in"]
# Types in their order, categories that decide the type, categories for which the brand does.
TYPES = ["government impersonation", "tech support", "bank alert", "delivery and toll", "family emergency", "romance", "investment and crypto", "prize and lottery", "charity", "Medicare and health", "utility shutoff", "job offer", "other", "not a scam"]
CATEGORY_TYPE = {
    "prize/contest": "prize and lottery", "delivery": "delivery and toll", "wrong number/romance scam": "romance", "finance/crypto": "investment and crypto",
    "job advertisement": "job offer", "lawsuits/settlements": "government impersonation", "loans/credit": "other", "advertisement": "other",
}
BRAND_DECIDES = ["account alert", "other"]
# Loading order of the sources and the labels their words mean (spam, smishing).
LOAD_ORDER = ["smishtank", "smishing_dataset", "nus sms corpus", "mendeley sms phishing", "uci sms spam collection"]
LABEL_WORDS = {"ham": (0, 0), "spam": (1, None), "smishing": (1, 1)}
# White space in the sense of Unicode, spelled out because regex engines disagree on \s.
SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"[\p{L}\p{N}_]"
# Does a text contain a link; and the links themselves (prefix, host, path).
LINK_TLDS = "com|net|org|info|xyz|ru|cn|co|io|me|us|biz|top|link|click|vip|shop|site|online|icu|cc|tk|ml|ga|gq|buzz"
URL_PARTS = rf"(https?://|www\.)?([a-z0-9][a-z0-9.-]*\.[a-z]{{2,}})(/[^{SPACE}]*)?"
# What a template key blanks out.
TEMPLATE_URL = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
TEMPLATE_HOST = rf"[a-z0-9-]+\.[a-z]{{2,}}(?:/[^{SPACE}]*)?"
