"""Fixed values that must equal the reference's for identical results.

Everything in this module is data, stated as-is in its natural order.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — feature names, in output order
# ---------------------------------------------------------------------------
BASE_HEADER_FEATURES = [
    "To_empty",
    "BCC_notempty_To_empty",
    "Total_Recp",
    "Received_count",
    "Span_time",
    "From_symbol",
    "Subject_symbol",
    "Received_SPF",
    "Authentication_Results",
    "MessageID_domainname",
    "MessageID_dollar",
    "Reply_To_empty_symbol",
    "Reply_To_domain",
    "X_Mailer_exist",
    "Content_Transfer_Encoding",
    "Return_Path_empty",
    "Return_Path_From_domain",
]

EXTENDED_HEADER_FEATURES = [
    "from_username_length",
    "from_username_digit_ratio",
    "from_username_special_ratio",
    "from_username_suspicious_keyword",
    "from_domain_typosquat_score",
    "from_domain_subdomain_depth",
    "from_tld_suspicious",
    "replyto_username_length",
    "replyto_domain_typosquat_score",
    "replyto_tld_suspicious",
    "returnpath_username_length",
    "returnpath_domain_typosquat_score",
    "returnpath_tld_suspicious",
    "from_vs_replyto_edit_distance",
    "from_vs_returnpath_edit_distance",
    "from_vs_msgid_edit_distance",
]

ALL_HEADER_FEATURES = BASE_HEADER_FEATURES + EXTENDED_HEADER_FEATURES

# The six features that need the string-similarity ratio.
SIMILARITY_FEATURES = [
    "from_domain_typosquat_score",
    "replyto_domain_typosquat_score",
    "returnpath_domain_typosquat_score",
    "from_vs_replyto_edit_distance",
    "from_vs_returnpath_edit_distance",
    "from_vs_msgid_edit_distance",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — body featuriser settings
# ---------------------------------------------------------------------------
TFIDF_MAX_FEATURES = 5000
TFIDF_NGRAM_MIN = 1
TFIDF_NGRAM_MAX = 3
TFIDF_SUBLINEAR_TF = True
PRE_VOCAB_FACTOR = 3          # preliminary vocabulary = 3 x max_features
MIN_DF = 2                    # absolute document count
MAX_DF = 0.97                 # proportion of documents
LOG_ODDS_EPS = 1e-9

CV_FOLDS = 10
RANDOM_SEED = 42
SPLIT_TRAIN = 0.70
SPLIT_VAL = 0.15

# ---------------------------------------------------------------------------
# FIXED VALUES — domain lists
# ---------------------------------------------------------------------------
KNOWN_LEGIT_DOMAINS = [
    "gmail.com", "yahoo.com", "outlook.com", "hotmail.com",
    "apple.com", "google.com", "microsoft.com", "amazon.com",
    "paypal.com", "facebook.com", "twitter.com", "linkedin.com",
    "bdo.com.ph", "bpi.com.ph", "metrobank.com.ph",
    "gcash.com", "paymaya.com",
]

SUSPICIOUS_TLDS = [
    "tk", "ml", "ga", "cf", "gq",
    "xyz", "top", "club", "click", "download", "loan",
    "work", "party", "gdn", "stream", "bid", "win",
    "review", "faith", "date", "trade", "accountant",
]

SUSPICIOUS_USERNAME_KEYWORDS = [
    "security", "secure", "alert", "update", "verify", "confirm",
    "account", "login", "support", "helpdesk", "noreply", "no-reply",
    "admin", "service", "notification", "billing",
]

TYPOSQUAT_EXACT = 0.999       # best ratio at or above: identical, score 0
TYPOSQUAT_NEAR = 0.65         # best ratio at or above: near copy, score 1 - best

# ---------------------------------------------------------------------------
# FIXED VALUES — stop words (set semantics; order as published)
# ---------------------------------------------------------------------------
STOP_WORDS = [
    "a","about","above","after","again","against","all","am","an","and",
    "any","are","aren't","as","at","be","because","been","before","being",
    "below","between","both","but","by","can't","cannot","could","couldn't",
    "did","didn't","do","does","doesn't","doing","don't","down","during",
    "each","few","for","from","further","get","got","had","hadn't","has",
    "hasn't","have","haven't","having","he","he'd","he'll","he's","her",
    "here","here's","hers","herself","him","himself","his","how","how's",
    "i","i'd","i'll","i'm","i've","if","in","into","is","isn't","it",
    "it's","its","itself","let's","me","more","most","mustn't","my",
    "myself","no","nor","not","of","off","on","once","only","or","other",
    "ought","our","ours","ourselves","out","over","own","same","shan't",
    "she","she'd","she'll","she's","should","shouldn't","so","some","such",
    "than","that","that's","the","their","theirs","them","themselves","then",
    "there","there's","these","they","they'd","they'll","they're","they've",
    "this","those","through","to","too","under","until","up","very","was",
    "wasn't","we","we'd","we'll","we're","we've","were","weren't","what",
    "what's","when","when's","where","where's","which","while","who","who's",
    "whom","why","why's","will","with","won't","would","wouldn't","you",
    "you'd","you'll","you're","you've","your","yours","yourself","yourselves",
    "http","www","com","also","like","one","would","may","said","new",
    "use","used","using","just","well","way","even","know","make","see",
    "back","much","many","give","most","tell","also","us","however",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — suffix rules (pattern suffix, replacement), applied in order
# ---------------------------------------------------------------------------
LEMMA_RULES = [
    ("ying", "y"),
    ("ied", "y"),
    ("ies", "y"),
    ("ing", ""),
    ("tion", "te"),
    ("ations", "te"),
    ("ness", ""),
    ("ment", ""),
    ("ed", ""),
    ("er", ""),
    ("est", ""),
    ("ly", ""),
    ("s", ""),
]
MIN_STEM_LEN = 4

# ---------------------------------------------------------------------------
# FIXED VALUES — slang / abbreviation map
# ---------------------------------------------------------------------------
SLANG_MAP = {
    "u": "you", "r": "are", "ur": "your", "4": "for", "2": "to",
    "thx": "thanks", "pls": "please", "plz": "please",
    "gr8": "great", "b4": "before", "btw": "by the way",
    "asap": "as soon as possible", "fyi": "for your information",
    "idk": "i do not know", "omg": "oh my god",
    "lol": "laugh", "brb": "be right back",
    "gonna": "going to", "wanna": "want to", "gotta": "got to",
    "kinda": "kind of", "sorta": "sort of",
    "cant": "cannot", "wont": "will not", "dont": "do not",
    "ive": "i have", "im": "i am", "id": "i would",
    "youre": "you are", "youve": "you have", "youll": "you will",
    "its": "it is", "thats": "that is", "hes": "he is", "shes": "she is",
    "weve": "we have", "theyre": "they are", "theyll": "they will",
}

# ---------------------------------------------------------------------------
# FIXED VALUES — experiment dimensions, display labels, published baselines
# ---------------------------------------------------------------------------
CONDITIONS = ["header_only", "body_only", "fusion"]
CLASSIFIERS = ["NB", "RF", "SVM"]
CLF_DISPLAY = {"NB": "Naive Bayes", "RF": "Random Forest", "SVM": "SVM"}
COND_DISPLAY = {"header_only": "Header-only", "body_only": "Body-only", "fusion": "Early Fusion"}
METRIC_COLS = ["accuracy", "precision", "recall", "f1", "auc_roc", "pr_auc", "fpr_at_95tpr"]

# (source, dataset, accuracy %, method); None = not published
PUBLISHED_BASELINES = [
    ("Kulkarni_et_al_2020", "SpamAssassin", 93.56, "RF + Relief (header-only)"),
    ("Kulkarni_et_al_2020", "TREC7", None, "RF + Relief (header-only)"),
    ("Kulkarni_et_al_2020", "Nazario", None, "RF + Relief (header-only)"),
    ("Baccouche_et_al_2020", "SpamAssassin", 92.70, "LSTM (body-only)"),
    ("Baccouche_et_al_2020", "TREC7", 92.70, "LSTM (body-only)"),
    ("Baccouche_et_al_2020", "Nazario", 92.70, "LSTM (body-only)"),
]
HEADER_BASELINE_ACCURACY = 93.56   # compared where the dataset name contains this
HEADER_BASELINE_DATASET = "SpamAssassin"
TARGET_TPR = 0.95
