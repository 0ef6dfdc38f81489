"""Fixed values. They decide results, so they are stated as plain lists."""

# Names of a review text column, best first.
TEXT_COLUMN_NAMES = [
    "review text",
    "review_text",
    "reviewtext",
    "customer review",
    "review",
    "reviews",
    "comment",
    "comments",
    "feedback",
    "opinion",
    "message",
    "content",
    "description",
    "body",
    "text",
    "ulasan",
    "isi ulasan",
    "komentar",
    "tanggapan",
    "pesan",
    "deskripsi",
    "isi",
]
RATING_COLUMN_NAMES = ["rating", "score", "star"]
PRODUCT_COLUMN_NAMES = ["product name", "title", "item", "product"]
CATEGORY_COLUMN_NAMES = ["category", "class name", "department name", "brand", "department"]
MIN_TEXT_COLUMN_LENGTH = 10

# The columns of the base training table.
BASE_TEXT_COLUMN = "Review Text"
BASE_TARGET_COLUMN = "Recommended IND"

# Labels.
NEGATIVE, POSITIVE = 0, 1
LABEL_NAMES = {0: "Negative", 1: "Positive"}
UNKNOWN = "Unknown"

# Keywords by domain, in the order that decides ties, and the
# keywords that mark Indonesian text.
DOMAIN_KEYWORDS = {
    "clothing": ["fabric", "dress", "size", "wear", "fit", "shirt"],
    "shoes": ["sole", "running", "shoe", "sneaker", "comfortable", "tight", "grippy"],
    "electronics": ["battery", "screen", "charge", "sound", "button", "device"],
}
INDONESIAN_KEYWORDS = ["bagus", "jelek", "kecewa", "kurang", "mantap", "baju", "sepatu"]
GENERAL_DOMAIN = "general"
ROUTING_ROWS = 100

# Report aspects by domain.
DOMAIN_ASPECTS = {
    "clothing": ["Sizing & Fit", "Material & Fabric Quality", "Design & Style",
                 "Color Accuracy", "Durability & Washing"],
    "shoes": ["Comfort & Cushioning", "Sizing & Fit", "Sole & Grip Quality",
              "Durability & Wear", "Design & Aesthetics"],
    "electronics": ["Battery & Power", "Screen & Display", "Sound & Audio Quality",
                    "Build Quality & Durability", "Connectivity & Performance"],
    "general": ["Product Quality", "Sizing & Fit", "Material Quality", "Design & Style",
                "Customer Service", "Shipping & Delivery", "Pricing & Value"],
}

# Report sections, error mark and search texts.
REPORT_SECTIONS = ["## 📋 Executive Summary", "## 🔍 Categorized Pain Points",
                   "## 🎯 High-Priority Action Items"]
ERROR_MARK = "_⚠️"
NO_REVIEWS_REPORT = "_The search found no review on this topic, so there is nothing to report._"
GENERIC_QUERY = "negative complaint problem issue bad disappointed kecewa jelek lambat rusak"
NEGATIVE_TOPIC = "negative complaint problem issue bad disappointed"
REFINE_SUFFIX = "complaint problem issue"

# Report loop and clustering sizes.
MAX_REFINE_ROUNDS = 2
WIDEN_PER_ROUND = 5
CLUSTERS = 4
KEYWORDS_PER_CLUSTER = 5
SAMPLES_PER_CLUSTER = 3
MIN_TEXTS_TO_CLUSTER = 6
CLUSTER_VOCABULARY = 500

# White space, and the cell texts that a CSV reader takes as missing.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
              "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
MISSING_CELLS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                 "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                 "nan", "null"]

# Default stop words: common English function words. Every operator that removes
# stop words takes the list as a parameter.
STOP_WORDS = (
    "about above after again against all almost also although always am among an and any "
    "are as at be because been before being below between both but by can cannot could did "
    "do does doing down during each either else ever every few for from further had has have "
    "having he hence her here hers herself him himself his how however if in indeed into is "
    "it its itself just least less many may me might mine more most much must my myself "
    "neither never no nor not now of off often on once only or other others our ours "
    "ourselves out over own per perhaps rather same she should since so some still such than "
    "that the their theirs them themselves then there therefore these they this those "
    "through thus to together too toward under until up upon us very was we were what when "
    "where whether which while who whom whose why will with within without would yet you "
    "your yours yourself yourselves"
).split()
