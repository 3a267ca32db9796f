"""Word lists, key lists, priors and weights that results depend on.

Everything here is plain data.  Nothing is computed apart from small derived
views, so a reader can check each list against the product definition.
"""

# Retrieval stop words.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from",
    "i", "in", "is", "it", "me", "my", "of", "on", "or", "please", "some",
    "that", "the", "this", "to", "want", "with", "would", "you", "looking",
)

# First-match material and color words.
MATERIALS = ("cotton", "polyester", "nylon", "leather", "wool", "spandex", "silk", "rayon", "fabric")
COLORS = (
    "black", "white", "blue", "red", "pink", "green", "brown", "gray", "grey", "purple", "yellow", "orange",
)

# Keys looked up in a product's detail map, in order of preference.
STYLE_KEYS = ("Style", "Fit Type", "Pattern", "Neck Style", "Sleeve Type", "Closure Type")
BRAND_KEYS = ("Brand", "Brand Name", "Manufacturer")
USE_CASE_KEYS = ("Sport", "Sport Type", "Occasion", "Theme")
SIZE_KEYS = ("Size",)

# Category labels.
UMBRELLA_LABELS = ("clothing", "clothing shoes & jewelry", "clothing, shoes & jewelry")
GENERIC_CATEGORIES = ("clothing", "clothing shoes jewelry")
DEFAULT_CATEGORY = "clothing item"
MALFORMED_CATEGORY_PREFIX = "shoes & jewelry "
SHOE_TERMS = (
    "boot", "boots", "cleat", "cleats", "footwear", "sandal", "sandals",
    "shoe", "shoes", "slipper", "slippers", "sneaker", "sneakers",
)
JEWELRY_TERMS = (
    "anklet", "anklets", "bracelet", "bracelets", "brooch", "brooches",
    "charm", "charms", "earring", "earrings", "jewelry", "necklace",
    "necklaces", "pendant", "pendants", "ring", "rings",
)
DEPARTMENT_LABELS = ("Baby", "Boys", "Girls", "Men", "Women")

# Audience words, in the order in which they are tried.
AUDIENCE_UNISEX = "unisex"
AUDIENCE_BABY = ("baby", "infant")
AUDIENCE_CHILD = ("boy", "boys", "girl", "girls", "child", "children", "kid", "kids")
AUDIENCE_RULES = (
    ("womens", ("women", "womens", "woman", "female", "ladies", "lady")),
    ("mens", ("men", "mens", "man", "male")),
    ("girls", ("girls", "girl")),
    ("boys", ("boys", "boy")),
    ("baby", ("baby", "infant")),
)
AUDIENCE_WORDS = (
    "unisex", "baby", "infant", "women", "womens", "woman", "female",
    "ladies", "lady", "men", "mens", "man", "male", "girls", "girl",
    "boys", "boy", "child", "children", "kid", "kids",
)

# BM25 field weights and constants.
BM25_FIELDS = ("title", "categories", "features", "details", "store", "description")
BM25_WEIGHTS = {"title": 6.0, "categories": 4.0, "features": 2.5, "details": 2.5, "store": 1.5, "description": 1.0}
BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6
LEXICAL_LIMIT = 1000
BROAD_LIMIT = 120
STRICT_LIMIT = 80
TOP_K = 10
QUERY_TERM_LIMIT = 40

# Scoring weights.
COMPONENTS = ("lexical", "category", "constraint", "department", "bayesian_rating", "popularity")
INTENT_WEIGHTS = {
    "buying": {
        "lexical": 0.25, "category": 0.35, "constraint": 0.20,
        "department": 0.05, "bayesian_rating": 0.05, "popularity": 0.10,
    },
    "browsing": {
        "lexical": 0.35, "category": 0.20, "constraint": 0.15,
        "department": 0.05, "bayesian_rating": 0.10, "popularity": 0.15,
    },
}
PRICE_WEIGHT = 0.15
EMBEDDING_WEIGHTS = {"buying": 0.05, "browsing": 0.08}

# Question attributes and their priors per category group.
QUESTION_ATTRIBUTES = ("material", "color", "style", "size", "budget", "feature", "use_case")
MIN_ATTRIBUTE_PRODUCTS = 5
QUESTION_CANDIDATES = 100
QUESTIONS_PER_ATTRIBUTE = 2
ATTRIBUTE_PRIORS = {
    "clothing": {
        "material": 0.72, "color": 0.40, "style": 0.80, "size": 1.00, "budget": 0.10, "feature": 0.93, "use_case": 0.25,
    },
    "shoes": {
        "material": 0.55, "color": 0.55, "style": 0.50, "size": 0.96, "budget": 0.10, "feature": 1.00, "use_case": 0.65,
    },
    "jewelry": {
        "material": 0.74, "color": 0.60, "style": 0.85, "size": 0.30, "budget": 0.10, "feature": 1.00, "use_case": 0.75,
    },
}
PROFILE_ATTRIBUTES = {
    "material": ("material",),
    "style": ("style",),
    "fit": ("style",),
    "weather": ("use_case", "feature"),
    "warmth": ("use_case", "feature"),
    "performance": ("use_case",),
    "comfort": ("feature",),
    "durability": ("feature",),
}

# Constraint types, tried in this order by substring.
CONSTRAINT_TYPES = (
    ("material", MATERIALS),
    ("color", ("color", "black", "white", "blue", "red", "pink", "green")),
    ("size", ("size", "sizing", "width", "wide", "narrow")),
    ("style", ("department", "style", "fit", "sleeve", "neck")),
    ("use_case", ("hiking", "running", "gym", "winter", "outdoor", "work")),
)

# Evaluation.
MAX_TURNS = 10
SCENARIO_SHARES = {"buying": 0.40, "browsing": 0.40, "intent_override": 0.15, "boundary": 0.05}
SCENARIO_DIFFICULTY = {"buying": "easy", "browsing": "medium", "intent_override": "hard", "boundary": "medium"}

# Stop words of the conversational tokenizer.
CONVERSATION_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "do", "for", "from",
    "have", "i", "in", "is", "it", "me", "my", "of", "on", "or", "please", "some",
    "that", "the", "this", "to", "want", "with", "would", "you", "looking", "need",
    "what", "those", "options", "quite", "right", "yet", "ask", "about", "one",
    "specific", "attribute", "matters", "key", "requirement", "currently", "still",
    "exploring", "additional", "preference", "use", "your", "judgment", "actually",
    "ignore", "earlier", "prioritize", "target", "requirements", "here", "closest",
    "found", "not", "too", "only", "shopping", "searching", "main", "thing",
    "important", "detail", "deciding", "factor", "strong", "flexible", "choose",
    "fits", "best", "works", "decide", "previous", "choice", "before", "rather",
    "disregard", "said", "forget", "instead", "now", "longer", "switch", "change",
    "replace", "don", "dont", "fine", "okay", "ok", "sounds",
)
