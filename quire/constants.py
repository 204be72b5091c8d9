"""Tunable defaults and the two word lists of the engine."""

from __future__ import annotations

TIERS = ("fast", "balanced", "best")
DEFAULT_TIER = "fast"
INDEX_VERSION = 2
SOURCE_WARN_LIMIT = 10
PAGES_PER_SECOND = {"fast": 3.0, "balanced": 0.6, "best": 0.5}
MIN_PAGES_FOR_RATE = 5

SUPERSCRIPT_FLAG = 1
MIN_TEXT_CHARS = 20
SCANNED_RATIO = 0.8
MAX_FOLIO = 9999
FOLIO_BAND = 3
HEADING_RATIO = 1.25
MAX_HEADING_CHARS = 90

CHUNK_SIZE = 3
CHUNK_OVERLAP = 1
HEAD_RATIO = 0.3
MAX_HEAD_CHARS = 60
MIN_HEAD_PAGES = 4
EDGE_LINES = 2
MIN_EDGE_REPEATS = 3

LONG_QUERY_WORDS = 200
RRF_K = 60
SEARCH_POOL = 200
DEFAULT_K = 5
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25

TERM_POOL = 50
DEFAULT_TOP = 10
MIN_TERM_COUNT = 3
MIN_WORD_CHARS = 3
REST_SMOOTHING = 1.0
ABSORB_RATIO = 0.6
TERMS_PER_WORD = 2
MIN_CONTRAST_NORM = 1e-6

MAX_NAMED_AUTHORS = 2

#: Tokens that end in a full stop without ending a sentence, longest first.
ABBREVIATIONS = (
    "approx circa trans prof corp figs vols dept sept univ feb dec inc etc ltd i.e e.g fig aug vol jul jan jun sep "
    "mar apr eds chs nos mrs oct rev nov ca ed cf ch al co no pp dr jr mr sr ms vs st "
).split()

#: Function words that never make a term, shortest first.
STOPWORDS = (
    "a i be he me we if of am an in on do no so to up or as is us at it by my had did and see she the one are use "
    "off all i'm him can own who too two her per for nor our has was his its get yet got not but out you few new "
    "how now may say way why any used said once made make like same some here were more else i've have each much "
    "such with both back well will them whom from than been then when even upon down also into ever over your it's "
    "does this hers less thus says that what most just must they only many very could would since three while there "
    "where these those whose above being doing which until still often again under other after their can't don't "
    "won't isn't might first about below should before itself during having though within rather either that's "
    "didn't aren't wasn't because through between further however weren't doesn't against without "
).split()
