"""The column vocabulary.

Rules are tried in this order and the first match decides. Several rules overlap
(``order`` comes before ``identifier``, ``arr`` matches inside any word), so the
order is part of the contract.
"""

# (pattern on the column name, ignoring case; class)
NAME_RULES = [
    (r"(^|_)roas($|_)|return_on_ad|return_on_spend", "roas"),
    (r"(^|_)ctr($|_)|click_?through", "ctr"),
    (r"(^|_)cpc($|_)|cost_per_click", "cpc"),
    (r"(^|_)cpm($|_)|cost_per_(mille|thousand)", "cpm"),
    (r"(^|_)(ad_?spend|spend|spent|budget_spent)($|_)", "spend"),
    (r"impression", "impression"),
    (r"(^|_)(gross_?profit|net_?profit|profit|earnings)($|_)", "profit"),
    (r"margin", "margin"),
    (r"discount|coupon", "discount"),
    (r"(^|_)(tax|vat|gst)($|_)", "tax"),
    (r"conversion|converted|cvr($|_)", "conversion"),
    (r"subscription|plan_?name|billing_?cycle|mrr|arr", "subscription"),
    (r"opportunit(y|ies)|pipeline_?value", "opportunity"),
    (r"(deal|opp)_?stage|sales_?stage", "deal_stage"),
    (r"page_?views?|screen_?views?", "pageview"),
    (r"(^|_)(traffic|visits?|visitors?)($|_)", "traffic"),
    (r"(^|_)(user|users|user_?id|account_?id)($|_)", "user"),
    (r"(^|_)(utm_\w+)($|_)|^utm_", "utm"),
    (r"referrer|referer|referral", "referrer"),
    (r"(^|_)(os|operating_?system)($|_)", "os"),
    (r"(^|_)(qty|quantity|units?)($|_)", "quantity"),
    (r"(^|_)(lat|latitude)($|_)", "latitude"),
    (r"(^|_)(lng|lon|longitude)($|_)", "longitude"),
    (r"revenue|gmv|turnover", "revenue"),
    (r"(total|sub)?_?(price|amount|cost|spend|budget|fee|charge)", "amount"),
    (r"currency", "currency"),
    (r"_rate$|rate_|percent|pct|ratio", "percentage"),
    (r"(^|_)(count|qty|quantity)($|_)|(^|_)num_|total_\w+s$", "count"),
    (r"unsubscribe", "unsubscribe"),
    (r"bounce", "bounce"),
    (r"(^|_)open(ed|s)?($|_)", "open"),
    (r"click", "click"),
    (r"repl(y|ies|ied)", "reply"),
    (r"refund", "refund"),
    (r"purchase", "purchase"),
    (r"invoice", "invoice"),
    (r"order", "order"),
    (r"campaign", "campaign"),
    (r"(^|_)lead", "lead"),
    (r"customer|client|buyer", "customer"),
    (r"(^|_)sku($|_)", "sku"),
    (r"product|item_name|catalog", "product"),
    (r"warehouse", "warehouse"),
    (r"inventory|stock", "inventory"),
    (r"shipment|shipping|tracking", "shipment"),
    (r"email|e_mail", "email"),
    (r"phone|mobile|tel($|_)", "phone"),
    (r"(^|_)url|link|website|domain", "url"),
    (r"country", "country"),
    (r"(^|_)city($|_)", "city"),
    (r"region|state|province", "region"),
    (r"address|location", "location"),
    (r"status|state$|health", "status"),
    (r"category|type$|kind|group", "category"),
    (r"(^|_)tags?($|_)", "tag"),
    (r"device", "device"),
    (r"browser", "browser"),
    (r"language|locale", "language"),
    (r"platform|source$|channel|medium", "platform"),
    (r"workspace|tenant", "workspace"),
    (r"team|department", "team"),
    (r"session", "session"),
    (r"duration|elapsed|runtime|latency", "duration"),
    (r"transaction|txn", "transaction"),
    (r"(^|_)(id|uuid|guid|key)$|_id$", "identifier"),
    (r"(^|_)name$|title", "name"),
    (r"description|notes?$|body|message", "description"),
    (r"(created|updated|deleted|sent|occurred|replied|opened|synced|started|ended|completed)"
     r"_?(at|on|date|time)|timestamp|_ts$|^date$|_date$", "timestamp"),
]

# declared type that settles the class on its own
DECLARED_CLASSES = {
    "timestamp": "timestamp",
    "boolean": "boolean",
    "json": "json",
    "array": "array",
    "uuid": "identifier",
}

TIME_CLASSES = ["date", "timestamp"]
ID_CLASSES = ["identifier"]

# numbers by definition, whatever the declared type
ALWAYS_METRIC = [
    "revenue", "amount", "spend", "profit", "margin", "discount", "tax",
    "roas", "ctr", "cpc", "cpm", "impression", "conversion", "quantity",
    "traffic", "pageview", "percentage", "rate", "count",
]

METRIC_CLASSES = [
    "currency", "revenue", "amount", "count", "percentage", "rate", "number", "duration",
    "reply", "click", "open", "bounce", "unsubscribe",
    "spend", "impression", "ctr", "roas", "cpc", "cpm", "conversion",
    "profit", "margin", "discount", "tax", "quantity", "traffic", "pageview", "session",
]

DIMENSION_CLASSES = [
    "country", "city", "region", "location", "status", "category", "tag", "campaign",
    "device", "browser", "language", "platform", "workspace", "team", "currency",
    "product", "sku", "warehouse", "boolean", "name",
    "subscription", "opportunity", "deal_stage", "channel", "os", "referrer", "utm", "user",
]

MONETARY = ["revenue", "amount", "currency", "spend", "profit", "discount", "tax", "cpc", "cpm"]
RATIO = ["percentage", "rate", "ctr", "margin", "conversion"]
INVERSE = ["bounce", "unsubscribe", "cpc", "cpm", "refund"]

CONCEPTS = {
    "revenue": ["revenue", "amount", "currency", "purchase", "transaction"],
    "spend": ["spend", "cpc", "cpm"],
    "profit": ["profit", "margin"],
    "orders": ["order", "quantity"],
    "customers": ["customer", "user"],
    "leads": ["lead"],
    "campaigns": ["campaign"],
    "clicks": ["click", "ctr"],
    "impressions": ["impression"],
    "engagement": ["open", "reply", "bounce", "unsubscribe", "conversion"],
    "products": ["product", "sku"],
    "inventory": ["inventory", "warehouse", "shipment"],
    "location": ["country", "city", "region", "location", "latitude", "longitude"],
    "email": ["email"],
    "time": ["date", "timestamp"],
    "sessions": ["session", "duration"],
    "traffic": ["traffic", "pageview", "referrer", "utm", "platform", "channel"],
    "device": ["device", "browser", "os", "language"],
    "subscriptions": ["subscription"],
    "invoices": ["invoice", "tax", "discount"],
    "opportunities": ["opportunity", "deal_stage"],
}

# best metric and best dimension first
METRIC_PRIORITY = ["revenue", "amount", "currency", "profit", "quantity", "count", "number"]
DIMENSION_PRIORITY = ["category", "product", "country", "region", "city", "channel", "status",
                      "platform", "campaign", "tag", "device"]
