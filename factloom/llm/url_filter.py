"""URL filters: logistic regression on hashed character n-grams of host and path.

The model is fitted in numpy on the driver from a small table of labelled URLs, and scores all
pages in one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import small_batches
from .columns import col
from .text import U64, lowered, mix, slices, utf8

BITS = 16
GRAMS = (3, 4, 5)
#: Share of the URLs to be kept, of hosts held out, that the threshold may reject.
MAX_LOSS = 0.01
FOLDS = 3

#: What public block lists are about, in single words that name it: gambling, adult, drugs, spam
#: and advertising, fraud, theft of works and of data.
_BAD_WORDS = (
    "casino", "casinos", "poker", "roulette", "blackjack", "jackpot", "slots", "slotmachine", "bingo", "lottery", "bets", "betting", "bookmaker", "sportsbook", "gamble", "gambling", "wager",
    "adult", "porn", "porno", "xxx", "sex", "sexy", "nude", "nudes", "erotic", "escort", "escorts", "hookup", "camgirls", "fetish", "hentai", "milf", "striptease",
    "viagra", "cialis", "levitra", "pills", "xanax", "tramadol", "steroids", "opioids", "painkillers", "slimming", "onlinepharmacy", "nicotine", "vape", "kratom",
    "spam", "spammer", "seo", "backlinks", "linkfarm", "clickbait", "doorway", "ads", "adserver", "adservice", "advert", "adverts", "banner", "banners", "popup", "popunder", "tracker", "trackers", "tracking", "telemetry", "affiliate",
    "phishing", "phish", "scam", "scams", "payday", "loans", "forex", "getrich", "prize", "giveaway", "freebies", "replica", "counterfeit", "doubler", "cryptomining", "cryptojacking", "malware", "spyware", "ransomware", "botnet", "trojan", "exploitkit",
    "warez", "keygen", "keygens", "torrent", "torrents", "nulled", "pirate", "pirated", "serialz", "crackz", "cracked", "leaked", "bypass",
)
_GOOD_STEMS = (
    "news", "daily-news", "city-library", "university", "science-journal", "open-data", "history-museum", "cooking-recipes", "garden-notes", "travel-guide", "weather", "health-institute", "medicine-review", "school-board", "physics-forum", "math-notes", "code-docs", "developer-blog", "linux-wiki", "football-report", "chess-club",
    "art-gallery", "music-review", "film-archive", "book-club", "government", "parliament", "court-records", "economics-today", "market-report", "bank-of-england", "energy-policy", "climate-data", "nature-photos", "bird-watching", "hiking-trails", "cycling", "railway-timetable", "airport", "bookshop", "furniture-store", "bakery", "farm-shop", "dairy-farm",
    "windmill", "winter-sports", "adulthood-studies", "address-book", "additive-manufacturing", "essex-county", "sussex-history", "betterment-society", "alphabet-books", "tablet-review", "spillway-engineering", "track-and-field", "racetrack", "soundtrack", "castle-tours", "casing-parts", "spanish-lessons", "spamalot-musical", "cheapside-london", "xylophone", "cracking-codes-museum", "slotted-tools",
    "lomira", "vantrel", "osterby", "quillan", "merrowdale", "thornwick", "hathersage", "entwistle", "ardington", "northolt", "kestrelmoor", "brinsop", "aldermaston", "otterburn", "ingatestone", "wetherby", "rothbury", "leatherhead", "sheringham", "antheron", "restonian", "wharfedale", "theroux",
    "garden", "library", "museum", "theatre", "orchestra", "village", "harbour", "mountain", "river", "forest", "meadow", "kitchen", "bakers", "butcher", "tailor", "carpenter", "plumber", "dentist", "doctor", "clinic", "hospital", "nursing", "teacher", "students", "college", "kindergarten",
    "football", "tennis", "rugby", "cricket", "swimming", "athletics", "sailing", "rowing", "camping", "trekking", "holiday", "hotels", "tourism", "railways", "airlines", "motors", "bicycle", "engineering", "software", "hardware", "database", "network", "security", "electronics", "robotics", "science",
    "chemistry", "biology", "geology", "astronomy", "statistics", "philosophy", "linguistics", "literature", "poetry", "archive", "heritage", "monuments", "cathedral", "parish", "charity", "foundation", "institute", "academy", "research", "journal", "magazine", "gazette", "tribune", "herald", "courier", "observer",
    "insurance", "savings", "accounting", "lawyers", "notary", "estate", "building", "architects", "furniture", "flowers", "jewellery", "clothing", "shoes", "toys", "books", "stationery", "groceries", "vegetables", "organic", "coffee", "teahouse", "wines", "cheese", "chocolate", "recipes", "restaurant",
    "federal", "ministry", "county", "council", "township", "embassy", "police", "firebrigade", "weatherman", "forecast", "meteorology", "environment", "recycling", "solar", "windpower", "hydrology", "oceans", "wildlife", "veterinary", "kennels", "horses", "beekeeping", "farmers", "vineyard", "orchard", "nursery",
    "translation", "dictionary", "encyclopedia", "forum", "community", "neighbours", "families", "parents", "wedding", "genealogy", "photography", "painting", "sculpture", "ceramics", "knitting", "woodwork", "guitar", "piano", "choir", "dance", "cinema", "podcast", "radio", "television", "station", "signal",
)
_BAD_PATHS = ("/{}", "/best/{}.html", "/{}-online", "/go.php?to={}", "/lp/{}/", "/{}/signup")
_GOOD_PATHS = ("/2021/05/12/report", "/article/1234", "/wiki/Main_Page", "/docs/index.html", "/news/local/story", "/about")
#: Paths that either kind of host has.
_PATHS = ("", "/", "/en/1", "/de/12.html", "/fr/123/", "/es/1234", "/en/12345#top", "/it/7?page=2&ref=x", "/index.html", "/p/99", "/a/b/c")
_TOPS = (".example.com", ".example.org", ".example.net", ".com", ".org", ".net", ".info")
_HEADS = ("", "www.", "m.", "blog.")


def labelled_urls(words: tuple[str, ...] = _BAD_WORDS) -> list[tuple[str, int]]:
    """The small labelled table: 1 for gambling, adult, drugs, spam, advertising, fraud and theft, 0 for others.

    A rejected host is one of words, alone or beside a word of a host that isn't rejected, so
    that only the word tells; every host has several addresses.
    """
    out = []
    bare = [w for w in _GOOD_STEMS if w.isalpha()]
    for i, word in enumerate(words):
        beside = [bare[(7 * i + k) % len(bare)] for k in range(4)]
        hosts = (word, f"{word}-{beside[0]}", f"{beside[1]}-{word}", f"{word}{beside[2]}", f"{beside[3]}{word}", f"{word}{i % 10}{i % 7}")
        for k, host in enumerate(hosts):
            path = _BAD_PATHS[i % len(_BAD_PATHS)].format(word) if k == 0 else _PATHS[(i + 3 * k) % len(_PATHS)]
            out.append((f"http{'s' * (k % 2)}://{_HEADS[(i + k) % 4]}{host}{_TOPS[(i + 2 * k) % 7]}{path}", 1))
    for i, stem in enumerate(_GOOD_STEMS):
        other = _GOOD_STEMS[(5 * i + 3) % len(_GOOD_STEMS)]
        for k, host in enumerate((stem, stem, f"{stem}-{other}", f"{other}{stem}", stem, f"{stem}{i % 10}{i % 7}")):
            path = _GOOD_PATHS[i % len(_GOOD_PATHS)] if k == 0 else _PATHS[(i + 3 * k) % len(_PATHS)]
            out.append((f"http{'s' * (k % 2)}://{_HEADS[(i + k) % 4]}{host}{_TOPS[(i + 2 * k) % 7]}{path}", 0))
    return out


@dataclass
class UrlModel:
    """score = sigmoid(sum of the weights of a URL's distinct n-grams, over the root of their number, + bias)."""

    weights: np.ndarray
    bias: float
    threshold: float = 0.5


def host_and_path(urls: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The host, without user, port and a leading www, and the path, without query and fragment."""
    bare = pc.replace_substring_regex(pc.utf8_lower(urls), r"^[a-z][a-z0-9+.\-]*://", "")
    bare = pc.replace_substring_regex(bare, r"[?#].*", "")
    host = pc.replace_substring_regex(bare, r"/.*", "")
    host = pc.replace_substring_regex(pc.replace_substring_regex(host, r"^.*@", ""), r"(:\d+)?$", "")
    host = pc.replace_substring_regex(host, r"^www\.", "")
    return host, pc.replace_substring_regex(bare, r"^[^/]*", "")


def grams(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each URL, host and path apart, as buckets and n + 1 offsets."""
    keys = []
    for part, texts in enumerate(host_and_path(urls)):
        texts = pc.binary_join_element_wise("^", texts.fill_null(""), "$", "")
        data, off = utf8(texts)
        data = lowered(data)
        data = np.where((data >= 48) & (data <= 57), np.uint8(48), data).astype(U64)  # a digit is a digit
        row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(off))
        for n in GRAMS:
            if len(data) < n:
                continue
            h = np.full(len(data) - n + 1, part * 8 + n, U64)
            for k in range(n):
                h = h * U64(0x100000001B3) + data[k : len(data) - n + 1 + k]
            h, own = mix(h) >> U64(64 - BITS), row[n - 1 :] == row[: len(row) - n + 1]
            keys.append((row[: len(own)][own] << BITS) | h[own].astype(np.int64))
    all_ = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    all_.sort()
    if len(all_):
        all_ = all_[np.append(True, all_[1:] != all_[:-1])]
    return all_ & ((1 << BITS) - 1), np.searchsorted(all_, np.arange(len(urls) + 1, dtype=np.int64) << BITS)


def _logits(weights: np.ndarray, bias: float, idx: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(weights[idx], dtype=np.float64)])
    return (sums[off[1:]] - sums[off[:-1]]) / np.sqrt(np.maximum(np.diff(off), 1)) + bias


def fit_urls(labelled: list[tuple[str, int]], epochs: int = 500, rate: float = 20.0, decay: float = 1e-5, max_loss: float = MAX_LOSS) -> UrlModel:
    """A model by gradient descent with momentum on the logistic loss, both classes weighing the same.

    The threshold rejects at most max_loss of the URLs to be kept, each scored by a model that
    hasn't seen its host (FOLDS of them). URLs that are null are skipped; an empty table gives a
    model that rejects nothing.
    """
    rows = [(u, y) for u, y in labelled if u is not None and y is not None]
    y = np.array([b for _, b in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return UrlModel(np.zeros(1 << BITS, np.float32), 4.0 if len(y) and y[0] else -4.0)
    urls = pa.array([a for a, _ in rows], pa.string())
    buckets, off = grams(urls)
    used, idx = np.unique(buckets, return_inverse=True)
    row = np.repeat(np.arange(len(y)), np.diff(off))
    fold = np.array([zlib.crc32(h.encode()) % FOLDS for h in host_and_path(urls)[0].to_pylist()])
    found = np.zeros(len(y))
    for k in range(FOLDS):
        if len(set(y[fold != k])) == 2:
            weights, bias = _descended(len(used), idx, off, row, y, fold != k, epochs, rate, decay)
            found[fold == k] = _logits(weights, bias, idx, off)[fold == k]
    weights, bias = _descended(len(used), idx, off, row, y, np.ones(len(y), bool), epochs, rate, decay)
    kept = np.sort(found[y == 0])
    least = kept[len(kept) - 1 - int(max_loss * len(kept))] + 1e-6
    whole = np.zeros(1 << BITS, np.float32)
    whole[used] = weights
    return UrlModel(whole, float(bias), float(1 / (1 + np.exp(-least))))


def _descended(size: int, idx: np.ndarray, off: np.ndarray, row: np.ndarray, y: np.ndarray, own: np.ndarray, epochs: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Weights and bias from the rows of own."""
    w, bias = np.zeros(size), 0.0
    norm = 1 / np.sqrt(np.maximum(np.diff(off), 1))
    weight = np.where(y == 1, 0.5 / y[own].sum(), 0.5 / (1 - y[own]).sum()) * own
    speed, speed_b = np.zeros_like(w), 0.0
    for _ in range(epochs):
        d = (1 / (1 + np.exp(-_logits(w, bias, idx, off))) - y) * weight
        g = np.bincount(idx, (d * norm)[row], minlength=len(w)) + decay * w
        speed, speed_b = 0.9 * speed - rate * g, 0.9 * speed_b - 0.1 * rate * d.sum()
        w, bias = w + speed, bias + speed_b
    return w, bias


def fit_url_table(labelled: DataFrame, limit: int = 100_000) -> UrlModel:
    """fit_urls() on a table (url, label), of which at most limit rows are taken, in the order of a hash."""
    rows = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("int")).orderBy(F.xxhash64("url"), "url", "label").limit(limit).collect()
    return fit_urls([(r[0], r[1]) for r in rows])


def url_score(spark: SparkSession, model: UrlModel, url: Column | str = "url") -> Column:
    """A Column with the probability that a URL is to be rejected; null for a null URL."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias))  # 256 KB, whatever the data

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, bias = shared.value
        for urls in batches:
            parts = [_logits(weights, bias, *grams(urls.slice(at, n))) for at, n in slices(urls, 1 << 19)]
            found = 1 / (1 + np.exp(-np.concatenate(parts))) if parts else np.zeros(0)
            yield pa.array(found, pa.float64(), mask=urls.is_null().to_numpy(zero_copy_only=False))

    return score(url)


def filter_urls(pages: DataFrame, model: UrlModel, threshold: float | None = None, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """(page_id, url, score, rejected) for every row of pages; rejected from the model's threshold
    on, or the one given.

    A null URL scores null and isn't rejected; an empty one has no n-grams but the marks of its
    ends. Query and fragment don't count, nor does case; whole URLs count, however long. A null
    id stays null; repeated rows each get their row; an empty table gives an empty result. Other
    columns are left aside, whatever their names.
    """
    own = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"))
    scored = own.withColumn("score", url_score(pages.sparkSession, model, F.col("url")))
    return scored.withColumn("rejected", F.coalesce(F.col("score") >= F.lit(model.threshold if threshold is None else threshold), F.lit(False)))
