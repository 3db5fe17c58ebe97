"""Fixed values.

FIXED VALUES: everything in this module must equal the values the
original pipeline uses, otherwise results differ.  They are stated here
plainly, in their natural order, and nowhere else.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — sentiment label bit flags and their names
# ---------------------------------------------------------------------------
POS = 1
NEG = 2
NEU = 4
OBJ = 8
OON = 16

LABEL_NAMES = {
    "positive": POS,
    "negative": NEG,
    "neutral": NEU,
    "objective": OBJ,
    "objective-OR-neutral": OON,
}

# Class letters of the command-line class selection (p n e o r).
CLASS_LETTERS = {"p": POS, "n": NEG, "e": NEU, "o": OBJ, "r": OON}

# Placeholder text of unavailable posts.
NOT_AVAILABLE = "Not Available"

# ---------------------------------------------------------------------------
# FIXED VALUES — text normalisation
# ---------------------------------------------------------------------------
URL_TOKEN = "http://url"
USER_TOKEN = "@ref"

# Negation cue words (whole token, case-sensitive); any token containing
# "n't" is a cue as well.
NEGATION_WORDS = [
    "never", "no", "nothing", "nowhere", "noone", "none", "not",
    "havent", "hasnt", "hadnt", "cant", "couldnt", "shouldnt", "wont",
    "wouldnt", "dont", "doesnt", "didnt", "isnt", "arent", "aint",
]
NEGATION_INFIX = "n't"
NEGATION_SUFFIX = "_NEG"
# A token containing one of these characters ends a negation scope.
PUNCT_RE = r"[.,:;!?]"

# Character repeated three or more times (within a token).
ELONGATED_RE = r"([^ ])\1{2,}"

# Emoticon pattern (searched inside a token).
EMOTICON_RE = (
    r"(?:[<>]?[:;=8][\-o\*\']?[\)\]\(\[dDpP/\\:\}\{@\|\\]"
    r"|[\)\]\(\[dDpP/\\:\}\{@\|\\][\-o\*\']?[:;=8][<>]?)"
)
QUESTION_RUN_RE = r"\?{2,}"
EXCLAIM_RUN_RE = r"!{2,}"
MIXED_RUN_RE = r"[!\?]{2,}"

# Part-of-speech tag vocabulary, in feature order (index 0 .. 24).
POS_TAGS = [
    "N", "O", "^", "S", "Z", "V", "A", "R", "!", "D", "P", "&", "T",
    "X", "#", "@", "~", "U", "E", "$", ",", "G", "L", "M", "Y",
]

# HTML entities decoded by the clean-up step; '&amp;' is applied last so
# that '&amp;lt;' decodes exactly once.
HTML_ENTITIES = [
    ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"),
    ("&OElig;", "Œ"), ("&oelig;", "œ"), ("&Scaron;", "Š"),
    ("&scaron;", "š"), ("&Yuml;", "Ÿ"), ("&circ;", "ˆ"),
    ("&tilde;", "˜"), ("&ndash;", "–"), ("&mdash;", "—"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&sbquo;", "‚"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&bdquo;", "„"),
    ("&dagger;", "†"), ("&Dagger;", "‡"), ("&permil;", "‰"),
    ("&lsaquo;", "‹"), ("&rsaquo;", "›"), ("&euro;", "€"),
    ("&amp;", "&"),
]

# Tag prefix -> lemma part of speech (adjective, verb, noun, adverb).
WN_NOUN, WN_VERB, WN_ADJ, WN_ADV = "n", "v", "a", "r"
WN_NOUN_TAGS = ["N", "S", "Z", "L", "M"]

# ---------------------------------------------------------------------------
# FIXED VALUES — feature union weights
# ---------------------------------------------------------------------------
FEATURE_WEIGHTS = {
    "word_ngram": 1.0,
    "char_ngram": 1.0,
    "all_caps_count": 0.2,
    "hashtag_count": 0.2,
    "punctuation_count": 0.2,
    "elongated_count": 0.2,
    "emoticon_count": 0.2,
    "pos": 0.2,
    "sent": 0.05,
    "nrc": 0.05,
    "length": 0.2,
}
TFIDF_MAX_DF = 0.75
WORD_NGRAM_RANGE = (1, 5)
CHAR_NGRAM_RANGE = (1, 5)
OLD_WORD_NGRAM_RANGE = (1, 2)
OLD_CHAR_NGRAM_RANGE = (1, 4)
SVM_C = 0.5
OLD_SVM_C_GRID = [1, 2, 3, 4, 5, 6, 7, 8, 9]

# ---------------------------------------------------------------------------
# FIXED VALUES — mutator configuration of the back-feed run
#   (symmetric range threshold, weight) per mutator
# ---------------------------------------------------------------------------
MUTATOR_SETTINGS = {
    "cl": (1.5, 5.0),
    "af": (0.4, 2.2),
    "km": (2.5, 40.0),
}

# Threshold sweep: 0.1 .. 0.9 step 0.05; precision needs 10 % coverage.
SWEEP_START, SWEEP_STOP, SWEEP_STEP = 0.1, 0.9, 0.05
SWEEP_MIN_PERCENT = 0.1

# Back-feed defaults.
POOL_LIMIT = 5000
BACKFEED_AMOUNT = 300
BACKFEED_ROUNDS = 30
MAIN_ROUNDS = 5

# Histogram / profile defaults.
PROFILE_BUCKETS = 25
PROFILE_MAX_ROWS = 50000
DISTANCE_BAR_WIDTH = 160

# k-means study.
KMEANS_K = 8
KMEANS_RESTARTS = 50
KMEANS_SAMPLE = 20000

# Density clustering eps grid (cosine distance); duplicates and values
# above the largest possible cosine distance (2) are dropped when used.
DBSCAN_EPS = [
    0.3, 0.6, 0.9, 1.10, 1.42, 1.74, 2.01, 2.24, 2.45, 2.75, 3.00, 3.25,
    3.50, 3.75, 4.00, 4.25, 4.50, 3.75, 4.00, 4.25, 4.50, 4.75, 5.00, 5.25,
    5.50, 5.75, 6.00, 6.25, 6.50, 6.75, 7.00, 7.25, 7.50, 7.75, 8.00,
]
MIN_CLUSTER_SHARE = 0.25

# Similarity schemes accepted for the similarity-table scorer.
SIMILARITY_SCHEMES = [
    "path", "hso", "lch", "lesk", "lin", "jcn", "random", "res",
    "vector_pairs", "wup",
]

# File batch size.
BATCH_SIZE = 10000

# ---------------------------------------------------------------------------
# FIXED VALUES — suffix detachment rules of the lemmatiser, in order, per
# part of speech: (suffix, ending put in its place); adverbs have none.
# ---------------------------------------------------------------------------
DETACHMENT_RULES = {
    WN_NOUN: [("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"),
              ("shes", "sh"), ("men", "man"), ("ies", "y")],
    WN_VERB: [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"),
              ("ed", ""), ("ing", "e"), ("ing", "")],
    WN_ADJ: [("er", ""), ("est", ""), ("er", "e"), ("est", "e")],
}
