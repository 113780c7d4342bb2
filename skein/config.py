"""Constants that results depend on."""

GLOBAL_SEED = 20250911
MIN_CUSTOMER_CHARS, MIN_BRAND_CHARS = 15, 20
TEST_SHARE, DEV_SHARE = 0.2, 0.1
MIN_REPLY_CHARS = 60
BM25_K1, BM25_B = 1.5, 0.75
RRF_K = 60
MARGIN_THRESHOLD = 0.10
TWEET_LIMIT = 280
WILSON_Z = 1.96
EVIDENCE_K = 4
