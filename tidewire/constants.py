"""Values that are part of the semantics."""

# --- fixed values: they must agree with the published behaviour for equal results ---
TOPICS = ["welt", "politik", "wirtschaft", "technologie", "wissenschaft"]
TOPIC_LABELS = {"welt": "Welt", "politik": "Politik", "wirtschaft": "Wirtschaft", "technologie": "Technologie", "wissenschaft": "Wissenschaft"}
TOPIC_BOOST = {"welt": 1.0, "wirtschaft": 1.0, "wissenschaft": 1.0, "politik": 0.7, "technologie": 0.6}
DEFAULT_BOOST = 0.5
RANK_WEIGHTS = {"source": 1.0, "cluster": 1.6, "position": 0.8, "recency": 1.2, "topic": 0.4}
HALF_LIFE_HOURS = 6.0
CLUSTER = {"threshold": 0.34, "same_source": 0.55, "window_hours": 36, "min_tokens": 3, "containment": 0.62, "min_shared": 3, "floor": 0.26, "df_cap": 60}
LEADS, BOARD_LIMIT, STRIP_LIMIT, SEARCH_LIMIT, BRIEF_LIMIT, MARKET_TOP, PAGE = 3, 120, 8, 60, 5, 5, 10
BOARD_HOURS, RAW_DAYS, ARCHIVE_DAYS, FUTURE_HOURS = 48, 7, 7, 6
UNKNOWN_RANK = 9999
TIME_ZONE = "Europe/Berlin"
TRACKING_PARAMETERS = [
    "ref", "cmp", "src", "source", "smid", "partner", "referrer", "referer", "at_medium", "at_campaign", "at_custom1", "at_custom2", "at_custom3",
    "at_custom4", "at_link_id", "at_link_type", "at_link_origin", "at_bbc_team", "ns_mchannel", "ns_source", "ns_campaign", "ns_linkname", "ns_fee",
    "ito", "CMP", "sh", "share", "fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "xtor", "wt_mc", "wt_zmc", "GEPC", "seite",
]
LIVE_PREFIX = (
    r"(?iu)^(liveblog|newsblog|ticker|live|update|kommentar|analyse|interview|gastbeitrag|podcast|video|audio|grafik|faq|portraet|portrait|nachruf|glosse|meinung)\b[:\s|-]*"
)
SOURCE_SUFFIX = (
    r"(?iu)\s*[-–|·]\s*(handelsblatt|tagesschau\.?de|der spiegel|spiegel online|faz\.net|zeit online|sz\.de|heise online|bbc news|the guardian|reuters|bloomberg|cnbc|npr)\s*$"
)
STEM_SUFFIXES = ["ern", "en", "er", "es", "e", "n", "s"]
CATEGORY_RULES = [
    ("wirtschaft", ["wirtschaft", "finanzen", "boerse", "borse", "markt", "markets", "business", "economy", "economics", "unternehmen", "companies", "finance", "money", "konjunktur", "handel", "trade", "banken", "immobilien"]),
    ("wissenschaft", ["wissenschaft", "wissen", "forschung", "science", "research", "health", "gesundheit", "medizin", "medicine", "klima", "climate", "environment", "umwelt", "natur", "physics", "biology", "space", "raumfahrt"]),
    ("technologie", ["technologie", "technik", "netzwelt", "digital", "technology", "tech", "it", "software", "internet", "ki", "artificial intelligence", "computing"]),
    ("welt", ["ausland", "welt", "world", "international", "global", "europa", "europe", "usa", "asien", "asia", "afrika", "africa", "nahost", "middle east", "ukraine"]),
    ("politik", ["politik", "politics", "inland", "innenpolitik", "bundestag", "wahl", "election", "government", "regierung", "eu-politik"]),
]
AGENCIES = ["dpa", "afp", "reuters", "ap", "epd", "kna", "sid", "bloomberg", "dpa-afx"]
#: first code, last code, icon, label
WEATHER_CODES = [
    (0, 0, "sun", "klar"), (1, 2, "sun", "leicht bewölkt"), (3, 3, "cloud", "bewölkt"), (45, 48, "fog", "Nebel"), (51, 57, "rain", "Niesel"), (61, 65, "rain", "Regen"),
    (66, 67, "rain", "gefrierender Regen"), (71, 77, "snow", "Schnee"), (80, 82, "rain", "Schauer"), (85, 86, "snow", "Schneeschauer"), (95, 99, "storm", "Gewitter"),
]
OTHER_WEATHER = ("cloud", "wechselhaft")
WEEKDAYS = ["MO", "DI", "MI", "DO", "FR", "SA", "SO"]
BAD_IMAGE = r"(?i)(pixel|tracking|1x1|blank|spacer|logo|avatar|placeholder)"
IMAGE_EXTENSION = r"(?i)\.(jpe?g|png|webp|avif|gif)(\?|$)"
IMAGE_TAG, IMAGE_SET = r"""<img[^>]+src=["']([^"']+)["']""", r"""srcset=["']([^"']+)["']"""
OG_PATTERNS = [
    r"""(?i)<meta[^>]+property=["']og:image(?::url)?["'][^>]*content=["']([^"']+)["']""",
    r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]*property=["']og:image(?::url)?["']""",
    r"""(?i)<meta[^>]+name=["']twitter:image(?::src)?["'][^>]*content=["']([^"']+)["']""",
    r"""(?i)<link[^>]+rel=["']image_src["'][^>]*href=["']([^"']+)["']""",
]
TILE_PALETTE = [("#f4f2ee", "#eae7e1"), ("#f1efe9", "#e6e3db"), ("#f5f3ef", "#ebe8e0"), ("#f2f0ea", "#e8e5dd")]
NAME_BOILERPLATE = [
    r"\bUCITS ETF\b", r"\bUCITS\b", r"\(Acc\)", r"\(Dist\)", r"\bAccumulating\b", r"\bDistributing\b", r"\(USD\)", r"\(EUR\)", r"\(GBP\)", r"\bUSD Acc\b", r"\bEUR Acc\b",
    r"\bUSD\b", r"\bEUR\b", r"\bGBP\b", r"\bClass A Common Stock\b", r"\bCommon Stock\b", r"\bOrdinary Shares\b", r"\bDepositary Receipt\b", r"\bETF\b", r"\bInc\.?(?=\s|$)",
    r"\bCorp(oration)?\.?(?=\s|$)", r"\bCo\.?(?=\s|$)", r"\bPLC\b", r"\bAG\b", r"\bSE\b", r"\bN\.V\.\b", r"\bLtd\.?(?=\s|$)", r"\([A-Z.]{1,6}\)\s*$",
]
MARKET_HISTORY, SEARCH_HISTORY, SPARK_POINTS, LOOKBACK_YEARS = 400, 2, 24, 3
MARKET_TTL_MINUTES, WEATHER_TTL_MINUTES = 720, 60
# --- end of fixed values ---

#: Frequent function words of German and English; a full list is a parameter of the token functions.
STOPWORDS = (
    "aber alle als also am an auch auf aus bei bis da das dass dem den der des die doch durch ein eine einem einen einer eines er es fuer gegen hat haben ich ihr im in ist "
    "ja kann kein man mehr mit nach nicht noch nun nur ob oder sein sich sie sind so ueber um und uns unter vom von vor war was wegen weil wenn wer wie wird wir zu zum zur "
    "about after all and are as at be been but by can could did do for from had has have he her his how if into is it its more new no not of on or our out over said says "
    "she than that the their them they this to up was we were what when which who will with would you"
).split()
