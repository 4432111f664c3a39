"""Defaults, column groups and prompt wording that results depend on."""

# Sampling and split defaults.
SEED = 2002
TEST_RATIO = 0.2
TRAIN_RATIO = 0.8
POPULAR_SHARE = 0.2
MIN_RATINGS = 5

# Similarity defaults.
EPSILON = 1e-9
DELTA = 25
VALID_NEIGHBOR_THRESHOLD = 0.6

# Collaborative-filtering context defaults.
RATINGS_PER_NEIGHBOR = 1
MAIN_USER_RATINGS = 4
SIMILAR_USERS = 4

# Confidence interval.
CONFIDENCE_Z = 1.96
BOOTSTRAP_RESAMPLES = 10000

# Text budget: a third of 4000 tokens per prompt part.
TOKEN_BUDGET = 4000 // 3

# Factor-model defaults.
MF_RANK_IMPLICIT = 20
MF_RANK_EXPLICIT = 10
MF_REG_EXPLICIT = 0.1
MF_ITERATIONS = 10
NUM_NEGATIVES = 4
FOREST_TREES = 10

# Column groups of the product-review data.
ITEM_SIDE_REVIEWS = [
    "asin", "title", "feature", "description", "price", "brand", "category",
    "tech1", "tech2", "also_buy", "also_view", "details", "main_cat",
    "similar_item", "date", "rank",
]

# Prompt wording.
ZERO_SHOT_TEMPLATE = (
    "How will user rate this product {target}? (1 being lowest and 5 being highest) "
    "Attention! Just give me back the exact number as a result, and you don't need a lot of text."
)
HISTORY_HEADER = "\n\nHere is user rating history:\n"
SIMILAR_HEADER = "\n\nHere is the rating history from users who are similar to this user:\n"
FEW_SHOT_TEMPLATE = (
    "\n\nBased on above rating history, please predict user's rating for the product {target}, "
    "(1 being lowest and 5 being highest,The output should be like: (x stars, xx%), "
    "do not explain the reason.)"
)
CF_TEMPLATE = (
    "\n\nBased on above rating history and similar users' rating history, please predict user's "
    "rating for the product {target}, (1 being lowest and 5 being highest,The output should be "
    "like: (x stars, xx%), do not explain the reason.)"
)
