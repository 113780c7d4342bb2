"""Document languages: averaged hashed subword embeddings with a linear softmax.

The model is trained by stochastic gradient descent in numpy on a bounded sample of labelled rows,
twice: rows on which the first model firmly disagrees with the label are left out of the second
fit. Words are scored by their subwords; a Viterbi pass over the words finds segments in other
languages. Confidence is the softmax after a temperature fitted on held-out rows, and what is below
the rejection threshold, the least confidence at which held-out texts were still right, is `und`.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import spread

LANGS = ("en", "es", "fr", "de", "pt", "it")  # what is told apart unless a caller names others
SAMPLE_ROWS = 12_000  # labelled rows a model is fitted on, all languages together
BUCKETS, DIM, EPOCHS, BATCH, RATE = 1 << 15, 16, (8, 10), 128, 0.25  # at higher rates one fit in ten ran astray
STEPS = 400  # a small sample is gone through more often, up to 60 times
KNOWN = 5  # a word seen less often in the sample, such as a name, counts for UNKNOWN of its score
UNKNOWN = 0.25
TEMPERATURES = 2.0 ** np.arange(-6, 5, 0.125)
KEEP_ERROR, MARGIN = 0.02, 0.25  # the share of accepted held-out texts that may be wrong
SWITCH = 7.0  # cost of a change of language between two words, in nats
FLOOR = 3.0  # a word counts against a language with this much at most
SEGMENT_WORDS, SEGMENT_CHARS = 3, 12  # whole clauses, not names or single words
MIN_CHARS = 12

NOISE = re.compile(r"https?://\S+|www\.\S+|[@#]\w+|&\w+;|\w*\d\w*")  # words glued to digits are codes
MAIL = re.compile(r"[\w.+-]+\s?(?:@|[(\[]at[)\]])\s?[\w-]+(?:(?:\.|\s?[(\[]dot[)\]]\s?)[\w-]+)+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")

def label(raw: Column) -> Column:
    """The language of a label without case and region; null for null, blank and `und`."""
    s = F.lower(F.trim(F.split(raw, "[-_]")[0]))
    return F.when(~s.isin("", "und"), s)


def words(text: str) -> list[str]:
    if "@" in text[1:] or "at)" in text:
        text = MAIL.sub(" ", text)
    return WORD.findall(NOISE.sub(" ", text).lower().replace("’", "'"))


def length(text: str) -> int:
    """Characters without handles and links."""
    return len(re.sub(r"\s+", " ", re.sub(r"https?://\S+|@\w+", "", text)).strip())


def subwords(word: str) -> np.ndarray:
    """Buckets of a word and of its runs of two to four characters, with its ends marked."""
    w = f"<{word}>"
    grams = [w] + [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
    return np.array([zlib.crc32(g.encode()) % BUCKETS for g in grams], np.int64)


class Model:
    """Word scores: the mean over a word's subwords of embedding times output weights."""

    def __init__(self, table: np.ndarray, bias: np.ndarray, temperature: float, reject: float, known: frozenset = frozenset(), langs: tuple = LANGS):
        self.known, self.langs = known, langs
        self.table, self.bias, self.temperature, self.reject = table, bias, temperature, reject
        self.cache: dict[str, tuple] = {}

    def word(self, w: str) -> tuple[np.ndarray, int]:
        got = self.cache.get(w)
        if got is None:
            if len(self.cache) > 100_000:
                self.cache.clear()
            ids = subwords(w)
            total, part = self.table[ids].sum(0), 1.0 if w in self.known else UNKNOWN
            mean = total / len(ids)
            cost = (np.minimum(mean.max() - mean, FLOOR) * part).tolist()
            got = self.cache[w] = (total * part, len(ids) * part, cost)
        return got

    def chances(self, total: np.ndarray, n: int) -> np.ndarray:
        z = (total / max(n, 1e-9) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def segments(self, text: str) -> list[tuple[str, str, float]]:
        """(segment, language, confidence), in order; one segment for a text of one language."""
        ws = words(text)
        if not ws:
            return []
        got = [self.word(w) for w in ws]
        p = self.chances(sum(g[0] for g in got), sum(g[1] for g in got))
        main = int(p.argmax())
        if sum(g[2][main] for g in got) <= SWITCH or len(ws) < 2 * SEGMENT_WORDS:
            return [(" ".join(ws), self.langs[main], float(p[main]))]
        return self._cut(ws, got)

    def _cut(self, ws: list[str], got: list[tuple]) -> list[tuple[str, str, float]]:
        k = len(self.langs)
        cost, back = list(got[0][2]), []
        for g in got[1:]:
            low = min(range(k), key=cost.__getitem__)
            jump = cost[low] + SWITCH
            step = [l if cost[l] <= jump else low for l in range(k)]
            cost = [min(cost[l], jump) + g[2][l] for l in range(k)]
            back.append(step)
        path = [min(range(k), key=cost.__getitem__)]
        for step in reversed(back):
            path.append(step[path[-1]])
        path.reverse()
        runs, lo = [], 0
        for i in range(1, len(path) + 1):
            if i == len(path) or path[i] != path[lo]:
                runs.append([lo, i, path[lo]])
                lo = i
        # what is shorter than a clause joins its longer neighbour
        while len(runs) > 1:
            short = [j for j, (a, b, _) in enumerate(runs) if b - a < SEGMENT_WORDS or sum(map(len, ws[a:b])) < SEGMENT_CHARS]
            if not short:
                break
            j = min(short, key=lambda j: runs[j][1] - runs[j][0])
            near = [i for i in (j - 1, j + 1) if 0 <= i < len(runs)]
            i = max(near, key=lambda i: runs[i][1] - runs[i][0])
            a, b = min(i, j), max(i, j)
            runs[a : b + 1] = [[runs[a][0], runs[b][1], runs[i][2]]]
            merged = []
            for r in runs:
                if merged and merged[-1][2] == r[2]:
                    merged[-1][1] = r[1]
                else:
                    merged.append(r)
            runs = merged
        out = []
        for a, b, l in runs:
            p = self.chances(sum(g[0] for g in got[a:b]), sum(g[1] for g in got[a:b]))
            out.append((" ".join(ws[a:b]), self.langs[l], float(p[l])))
        return out


def fit(texts: list[str], labels: list[int], n_langs: int, epochs: int, balanced: bool, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, output weights and bias by SGD on the mean embedding of each text's subwords."""
    rng = np.random.default_rng(seed)
    cache: dict[str, np.ndarray] = {}
    bags = []
    for t in texts:
        ids = [cache[w] if w in cache else cache.setdefault(w, subwords(w)) for w in words(t)]
        bags.append(np.concatenate(ids) if ids else np.zeros(0, np.int64))
    keep = [i for i, b in enumerate(bags) if len(b)]
    bags, y = [bags[i] for i in keep], np.array([labels[i] for i in keep], np.int64)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, n_langs), np.float32), np.zeros(n_langs, np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    weight = len(y) / (n_langs * np.maximum(np.bincount(y, minlength=n_langs), 1))
    weight = np.minimum(weight ** (1.0 if balanced else 0.5), 8).astype(np.float32)
    epochs = max(epochs, min(60, STEPS * BATCH // max(len(y), 1)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            at = order[lo : lo + BATCH]
            sizes = np.array([len(bags[i]) for i in at])
            flat = np.concatenate([bags[i] for i in at])
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            h = np.add.reduceat(emb[flat], starts, axis=0) / sizes[:, None]
            z = h @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p
            g[np.arange(len(at)), y[at]] -= 1
            g *= weight[y[at]][:, None] / len(at)
            gh = (g @ out.T) / sizes[:, None]
            out -= rate * (h.T @ g)
            bias -= rate * g.sum(0)
            # a rare subword would hardly move at the rate of the whole batch
            np.add.at(emb, flat, np.repeat((-rate * len(at) * gh).astype(np.float32), sizes, axis=0))
    return emb, out, bias


def temperature(z: np.ndarray, t: np.ndarray) -> float:
    """The temperature with the least log loss on held-out scores z and classes t.

    Targets are smoothed as for Platt scaling, by one row in n + 2 of them, so that rows without an
    error do not drive it to nought.
    """
    n, k = z.shape
    want = np.full((n, k), 1 / (n + 2) / max(k - 1, 1))
    want[np.arange(n), t] = (n + 1) / (n + 2)

    def loss(temp: float) -> float:
        q = z / temp
        q = q - q.max(1, keepdims=True)
        return float(-(want * (q - np.log(np.exp(q).sum(1, keepdims=True)))).sum(1).mean())

    return float(min(TEMPERATURES, key=loss))


def threshold(p: np.ndarray, right: np.ndarray) -> float:
    """The least confidence of texts that are kept: at MARGIN of the odds of the held-out text down
    to which at most KEEP_ERROR are wrong. Few texts are held out, and others lie a little below."""
    order = np.argsort(-p, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(p) + 1)
    fine = np.flatnonzero(wrong <= KEEP_ERROR)
    if not len(fine):
        return 1.0
    low = float(p[order][fine[-1]])
    return MARGIN * low / (1 - low + MARGIN * low)


def train(texts: list[str], labels: list[str], langs: tuple = LANGS) -> Model:
    """A model of labelled texts; labels may be wrong now and then. Needs at least one row."""
    y = [langs.index(l) for l in labels]
    held = np.array([zlib.crc32(t.encode()) % 10 == 0 for t in texts], bool)
    if held.all() or not held.any():
        held[:] = False
    fit_at = [i for i in range(len(texts)) if not held[i]]
    # fully balanced, the rows of a large language wrongly labelled as a small one would weigh too much
    emb, out, bias = fit([texts[i] for i in fit_at], [y[i] for i in fit_at], len(langs), EPOCHS[0], False)
    counts: dict[str, int] = {}
    for i in fit_at:
        for w in set(words(texts[i])):
            counts[w] = counts.get(w, 0) + 1
    known = frozenset(w for w, n in counts.items() if n >= min(KNOWN, 1 + len(fit_at) // 500))
    first = Model(emb @ out, bias, 1.0, 0.0, known, langs)

    def firmly_other(i: int) -> bool:
        segs = first.segments(texts[i])
        return len(segs) > 1 or bool(segs) and segs[0][1] != langs[y[i]] and segs[0][2] > 0.6

    good = [i for i in fit_at if not firmly_other(i)]
    if len({y[i] for i in good}) == len({y[i] for i in fit_at}):
        emb, out, bias = fit([texts[i] for i in good], [y[i] for i in good], len(langs), EPOCHS[1], True)
    model = Model(emb @ out, bias, 1.0, 0.0, known, langs)
    scored = []
    for i in np.flatnonzero(held):
        ws = [model.word(w) for w in words(texts[i])]
        if ws and length(texts[i]) >= MIN_CHARS and not firmly_other(i):
            scored.append((sum(g[0] for g in ws) / sum(g[1] for g in ws) + bias, y[i]))
    if len(scored) >= 50:
        z, t = np.array([s[0] for s in scored], np.float64), np.array([s[1] for s in scored])
        model.temperature = temperature(z, t)
        p = np.exp((z - z.max(1, keepdims=True)) / model.temperature)
        p /= p.sum(1, keepdims=True)
        model.reject = threshold(p.max(1), p.argmax(1) == t)
    return model


def sample(texts: DataFrame, rows: int = SAMPLE_ROWS, langs: tuple = LANGS) -> DataFrame:
    """Up to `rows` labelled texts, those of the smallest hashes, in their order: the same in any partitioning."""
    known = texts.where(F.col("label").isin(*langs) & F.col("text").isNotNull())
    n = known.count()
    unit = F.pmod(F.xxhash64("id", "text", F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = known.withColumn("unit", unit).where(F.col("unit") < min(1.0, 1.2 * rows / max(n, 1)))
    return some.orderBy("unit", "id", "text", "label").limit(rows).select("text", "label")


def fitted(texts: DataFrame, rows: int = SAMPLE_ROWS, langs: tuple = LANGS) -> Model | None:
    """A model fitted on a bounded sample of (id, text, label), or None where nothing is labelled."""
    got = sample(texts, rows, langs).collect()
    return train([r["text"] for r in got], [r["label"] for r in got], langs) if got else None


SEGMENTS = "id long, label string, seq int, segment string, lang string, confidence double, n_segments int"


def segmenter(*parts):
    def run(batches):
        model = Model(*parts)
        for b in batches:
            rows = []
            for i, t, l in zip(*(b.column(c).to_pylist() for c in ("id", "text", "label"))):
                segs = model.segments(t) if t and length(t) >= MIN_CHARS else []
                if not segs:
                    rows.append((i, l, 0, "", "und", 0.0, 0))
                n = len({s[1] for s in segs})
                rows += [(i, l, k, s, g if c >= model.reject else "und", c, n) for k, (s, g, c) in enumerate(segs)]
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in SEGMENTS.split(", ")])

    return run


def segments(texts: DataFrame, model: Model | None = None) -> DataFrame:
    """Segments (id, label, seq, segment, lang, confidence, n_segments) of (id, text, label).

    n_segments counts the text's languages. A null text, one without words and one of fewer than
    MIN_CHARS characters without handles and links give one empty segment in `und` of confidence 0;
    a segment no language is sure of is `und` too. Repeated rows give repeated segments; an empty
    table, or one without any label, gives none.
    """
    model = model or fitted(texts)
    if model is None:
        return texts.sparkSession.createDataFrame([], SEGMENTS)
    return spread(texts).mapInArrow(segmenter(model.table, model.bias, model.temperature, model.reject, model.known, model.langs), SEGMENTS)


def exchange_texts(exchanges: DataFrame) -> DataFrame:
    """(id, text, label) of the customer texts of exchanges."""
    return exchanges.where("customer_tweet_id is not null").select(F.col("customer_tweet_id").cast("long").alias("id"), F.col("customer_text").alias("text"), label(F.col("lang")).alias("label"))


def mislabelled(texts: DataFrame, model: Model | None = None) -> DataFrame:
    """(id, lang) of texts whose label is missing or wrong, and each language of mixed texts."""
    s = segments(texts, model).where(F.col("lang") != "und")
    return s.where((F.col("n_segments") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang"))).select("id", "lang").distinct()
