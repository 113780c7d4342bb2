"""Template residue, filler, error pages and script notices.

A regularized logistic regression over hashed n-grams of words and of their shapes, with title and
length features, is trained on weak labels: phrases and shapes that only residue has, and what the
status of the response says. The phrases make labels only, the model never sees whether one
matched. It decides; what it does not firmly call content is also looked at for the shape of an
unfilled slot. Hosts (the drafters, and the documents that replies come from) are split
so that the model is validated on hosts it has not seen.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import spread

SAMPLE_ROWS = 20_000  # rows a model is fitted on
BUCKETS, EPOCHS, BATCH, RATE, L2 = 1 << 18, 10, 32, 4.0, 1e-4
THRESHOLD = 0.5
DOUBT = 0.02  # down to this chance, a slot that is seen by its shape decides
WINDOW = 32  # tokens that are scored at once; a longer text is scored in windows that overlap by half
REMEMBERED = 100_000  # scores of texts that a task keeps, as replies repeat

# The project's masks, and the shapes of slots that were never filled.
MASKS = "user|url|email|flight|ref|phone|num"
LEADING = re.compile(r"^(?:\s*<user>)+")
MASK = re.compile(rf"<(?:{MASKS})>")
SLOT = re.compile(
    r"\{\{[^{}]{1,60}\}\}|\$\{[^{}]{1,60}\}|%\([A-Za-z_]\w*\)[sd]|<%=?[^%>]{1,60}%>|<<\s*[A-Za-z][\w .-]{1,40}\s*>>"
    r"|(?<![\w])__[A-Za-z][A-Za-z0-9_]*?__(?![\w])|%[A-Z][A-Z_]{2,}%|#[A-Z][A-Z_]{2,}#"
    r"|\[\s*(?:insert|enter|add|your)\b[^\]]{1,40}\]|\[[A-Z][A-Z_]{2,}(?: [A-Z]{2,}){0,3}\]|(?<![{$\w])\{[A-Za-z_]\w{1,30}\}"
)
ANGLE = re.compile(r"<([A-Za-z][A-Za-z_]*(?: [A-Za-z]+){0,2})>")
HTML = {"html", "head", "title", "body", "center", "noscript", "br", "p", "b", "i", "a", "div", "span", "script"}
#: Weak labels: phrases of residue, of prose that only talks about such things, by kind.
PHRASES = {
    "filler": r"(?i)\b(?:lorem|dolor sit|ipsum)\b|\b(\w{3,})(?:\s+\1){2,}\b|^\W*(?:tbd|todo|tbc|xxx+)\b|\bTODO:|\basdf|\bx{4,}\b|placeholder text|sample reply|texto de ejemplo|beispieltext|texte d'exemple|testo di esempio|texto de exemplo|to be supplied|replace before sending|sustituir antes|blah blah",
    "error": r"(?i)\b[45]\d\d (?:bad gateway|gateway time-?out|internal server error|service (?:temporarily )?unavailable|not found|forbidden)|HTTP(?:/1\.\d)? ?[45]\d\d\b|<html>|traceback \(most recent|(?:\w+\.)+\w*(?:Exception|Error)\b|\{\"error\"|(?:warning|notice|fatal error|parse error): .{1,200} on line \d+|upstream (?:gave|connect|sent)|access denied.{0,3}\s+you don't have|don't have permission to view|cannot handle the request|^\W*(?:error|fehler|erreur|errore|erro) \d{3}\b|p[áa]gina no encontrada|page (?:introuvable|not found)|pagina non trovata|seite nicht gefunden|dienst vor[üu]bergehend|service unavailable|stream was reset|page is out of order|page (?:is )?(?:broken|unavailable)\b",
    "scripts": r"(?i)(?:enable|allow|turn on|activate|requires?|activa|activez|aktivieren sie|attiva|ative|habilite).{0,40}(?:javascript|scripts?\b|scripting|cookies)|(?:javascript|scripts?|cookies).{0,30}(?:must be on|(?:is|are) (?:required|disabled|switched off)|to continue|to view)|<noscript>|browser is (?:not supported|unfit|out of date)|checking your browser",
}
WEAK = {k: re.compile(v) for k, v in PHRASES.items()}


def slots(text: str, masks_count: bool) -> bool:
    """Whether a slot was left unfilled. masks_count: masks after the leading <user>s are slots too."""
    t = LEADING.sub("", text)
    if masks_count and MASK.search(t):
        return True
    t = MASK.sub(" ", t)
    if SLOT.search(t):
        return True
    return any(m.group(1).lower() not in HTML for m in ANGLE.finditer(t))


def weak_label(text: str, error: str | None, masks_count: bool) -> int | None:
    """1 residue, 0 content, None unsure: from the status of the response, then from phrases and shapes."""
    if error or slots(text, masks_count) or any(rx.search(text) for rx in WEAK.values()):
        return 1
    return 0


TOKEN = re.compile(rf"<(?:{MASKS})>|\w+|[^\w\s]+")


def shape(token: str) -> str:
    """A token without its letters: marks stay, words show their case, underscores and digits."""
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:4]
    s = re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", lambda m: "X" if m.group().isupper() and len(m.group()) > 1 else "x" if m.group().islower() else "Xx" if m.group()[0].isupper() and m.group()[1:].islower() else "xX", token))
    return re.sub(r"(?:Xx){2,}", "xX", s)[:8]


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """Buckets of n-grams, given the hashes of their parts."""
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(7)).astype(np.int64) & (BUCKETS - 1)


PLAIN = np.array([zlib.crc32(b"shape " + x) for x in (b"x", b"Xx")], np.uint64)


def _shaped(*parts: np.ndarray) -> np.ndarray:
    """Buckets of n-grams of shapes; runs of plain words say nothing and are bucket 0, which has no weight."""
    return np.where(np.all([np.isin(p, PLAIN) for p in parts], axis=0), 0, _mixed(*parts))


class Reader:
    """Texts to token hashes; words and shapes are hashed once for each distinct token."""

    def __init__(self):
        self.seen: dict[str, tuple[int, int]] = {}

    def token(self, t: str) -> tuple[int, int]:
        got = self.seen.get(t)
        if got is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            got = self.seen[t] = (zlib.crc32(re.sub(r"\d+", "0", t.lower()).encode()), zlib.crc32(b"shape " + shape(t).encode()))
        return got

    def tokens(self, text: str, masks_count: bool) -> list[tuple[int, int]]:
        """Leading <user>s are left out; masks are one token, another where they count."""
        mask = "\x00slot" if masks_count else "\x00mask"
        return [self.token(mask if x[0] == "<" and MASK.fullmatch(x) else x) for x in TOKEN.findall(LEADING.sub("", text))]


class Windows:
    """The windows of a batch of texts, as places in the arrays of all n-grams of the batch.

    grams holds a bucket for each n-gram that starts at each token. A window of tokens lo to hi has
    the n-grams that lie wholly inside; with the whole text's title and length features (form) these
    are all its features. Together the windows of a text hold all its tokens.
    """

    def __init__(self, reader: Reader, texts: list[tuple[str, bool]], size: int = WINDOW):
        words, shapes, self.form, lo, hi, self.of = [], [], [], [], [], []
        for k, (text, masks_count) in enumerate(texts):
            got = reader.tokens(text, masks_count)
            n, at = len(got), len(words)
            words += [g[0] for g in got]
            shapes += [g[1] for g in got]
            letters = sum(map(str.isalpha, text)) * 10 // max(1, len(text))
            title = " ".join(str(g[0]) for g in got[:3])
            self.form.append([zlib.crc32(x.encode()) & (BUCKETS - 1) for x in (f"title {title}", f"first {title.split(' ')[0]}", f"length {len(text).bit_length()}", f"words {n.bit_length()}", f"letters {letters}", f"distinct {5 * len(set(got)) // max(n, 1)}")])
            starts = range(0, n - size // 2, size // 2) if n > size else (0,)
            lo += [at + s for s in starts]
            hi += [min(at + s + size, at + n) for s in starts]
            self.of += [k] * len(starts)
        w, s = np.array(words, np.uint64), np.array(shapes, np.uint64)
        n = len(w)
        wide = lambda x, k: np.r_[x, np.zeros(2, np.uint64)][k : k + n]
        w1, w2, s1, s2, s3 = wide(w, 1), wide(w, 2), wide(s, 1), wide(s, 2), wide(np.r_[s, np.zeros(1, np.uint64)], 3) if n else s
        #: (tokens an n-gram reaches beyond its first, buckets)
        self.grams = [(0, _mixed(w)), (1, _mixed(w, w1)), (2, _mixed(w, w1, w2)), (1, _shaped(s, s1)), (2, _shaped(s, s1, s2)), (3, _shaped(s, s1, s2, s3))]
        self.lo, self.hi, self.of = np.array(lo, np.int64), np.array(hi, np.int64), np.array(self.of, np.int64)
        self.n = sum(np.maximum(0, self.hi - self.lo - reach) for reach, _ in self.grams) + len(self.form[0]) if texts else np.zeros(0, np.int64)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """For each window, the sum of the weights of its features over the root of their number."""
        out = weights[np.array(self.form, np.int64)].sum(1)[self.of] if len(self.form) else np.zeros(0)
        for reach, ids in self.grams:
            total = np.r_[0.0, np.cumsum(weights[ids])]
            out = out + total[np.maximum(self.lo, self.hi - reach)] - total[self.lo]
        return out / np.sqrt(self.n)

    def features(self, k: int) -> np.ndarray:
        """Buckets of the features of window k."""
        return np.concatenate([self.form[self.of[k]], *(ids[self.lo[k] : max(self.lo[k], self.hi[k] - reach)] for reach, ids in self.grams)])


class Linear:
    """Weights of a logistic regression; plain numpy."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.reader = weights, bias, Reader()

    def chances(self, texts: list[tuple[str, bool]]) -> np.ndarray:
        """For each (text, masks_count) the highest chance of any of its windows."""
        out = np.zeros(len(texts))
        for lo in range(0, len(texts), 2000):
            win = Windows(self.reader, texts[lo : lo + 2000])
            z = np.clip(win.sums(self.weights) + self.bias, -30, 30)
            np.maximum.at(out, lo + win.of, 1 / (1 + np.exp(-z)))
        return out


def fit(rows: list[tuple[str, int, bool]], seed: int = 5) -> Linear:
    """SGD on the log loss with L2. A text is as much residue as the window that shows it most, so
    that window learns."""
    rng = np.random.default_rng(seed)
    y = np.array([l for _, l, _ in rows], np.float64)
    prior = min(max(y.mean(), 1e-4), 0.2)
    model = Linear(np.zeros(BUCKETS), float(np.log(prior / (1 - prior))))
    win = Windows(model.reader, [(t, m) for t, _, m in rows])
    first = np.searchsorted(win.of, np.arange(len(rows) + 1))
    bags = [win.features(k) for k in range(len(win.of))]
    root, w = np.sqrt(win.n), model.weights
    for epoch in range(EPOCHS):
        rate, order = RATE / (1 + epoch), rng.permutation(len(rows))
        for lo in range(0, len(rows), BATCH):
            at = order[lo : lo + BATCH]
            ks = np.concatenate([np.arange(first[i], first[i + 1]) for i in at])
            own = np.repeat(at, first[at + 1] - first[at])
            sizes = np.array([len(bags[k]) for k in ks])
            flat = np.concatenate([bags[k] for k in ks])
            z = np.add.reduceat(w[flat], np.r_[0, np.cumsum(sizes)[:-1]]) / root[ks] + model.bias
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]
            best = np.full(len(rows), -np.inf)
            np.maximum.at(best, own, z)
            top = z == best[own]
            g *= top / np.bincount(own, top, len(rows))[own]
            np.subtract.at(w, flat, np.repeat(rate * g / root[ks], sizes))
            w[flat] *= 1 - rate * L2
            w[0] = 0
    return model


def held_out(host: str | None) -> bool:
    """One host in five is kept for validation."""
    return zlib.crc32((host or "").encode()) % 5 == 0


def train(rows: list[tuple[str, str | None, str | None, bool]]) -> tuple[Linear | None, dict]:
    """A model and its figures on unseen hosts, of rows (text, error, host, masks_count).

    The figures count rows, rows on unseen hosts, those weakly labelled residue, those the model
    says are residue, and both. None without labels of both kinds.
    """
    labelled = [(t, l, m, held_out(h)) for t, e, h, m in rows if t and (l := weak_label(t, e, m)) is not None]
    part = [(t, l, m) for t, l, m, h in labelled if not h]
    test = [(t, l, m) for t, l, m, h in labelled if h]
    if len({l for _, l, _ in part}) < 2:
        part = [(t, l, m) for t, l, m, _ in labelled]
    if len({l for _, l, _ in part}) < 2:
        return None, {"rows": len(labelled)}
    model = fit(part)
    said = model.chances([(t, m) for t, _, m in test]) >= THRESHOLD
    weak = np.array([l for _, l, _ in test], bool)
    return model, {"rows": len(labelled), "unseen": len(test), "labelled": int(weak.sum()), "said": int(said.sum()), "both": int((said & weak).sum())}


def records(drafts: DataFrame, hits: DataFrame) -> DataFrame:
    """(src, record_id, sub_key, text, error, host, masks_count) of drafts and hits."""
    d = drafts.select(F.lit("drafts").alias("src"), F.col("id").cast("long").alias("record_id"), F.col("drafter").alias("sub_key"), "text", F.nullif(F.col("error"), F.lit("")).alias("error"), F.col("drafter").alias("host"), F.lit(True).alias("masks_count"))
    h = hits.select(F.lit("hits").alias("src"), F.col("qid").cast("long").alias("record_id"), F.col("rank").cast("string").alias("sub_key"), F.col("reply").alias("text"), F.lit(None).cast("string").alias("error"), F.concat(F.lit("hit:"), F.col("doc_id").cast("string")).alias("host"), F.lit(False).alias("masks_count"))
    return d.unionAll(h)


def fitted(rows: DataFrame, limit: int = SAMPLE_ROWS) -> tuple[Linear | None, dict]:
    """A model fitted on up to `limit` records, those of the smallest hashes, in their order."""
    known = rows.where(F.length("text") > 0)
    n = known.count()
    unit = F.pmod(F.xxhash64("src", "record_id", "sub_key", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = known.withColumn("unit", unit).where(F.col("unit") < min(1.0, 1.2 * limit / max(n, 1)))
    got = some.orderBy("unit", "src", "record_id", "sub_key", "text").limit(limit).select("text", "error", "host", "masks_count").collect()
    return train([tuple(r) for r in got])


SCORED = "src string, record_id long, sub_key string, chance double, slot boolean, phrase string"


def shown(text: str) -> str | None:
    """The kind of phrase that a text holds."""
    return next((n for n, rx in WEAK.items() if rx.search(text)), None)


def scorer(weights, bias):
    def run(batches):
        model, known = Linear(weights, bias) if weights is not None else None, {}
        for b in batches:
            keys = list(zip(b.column("text").to_pylist(), b.column("masks_count").to_pylist()))
            new = [k for k in dict.fromkeys(keys) if k not in known]
            if len(known) > REMEMBERED:
                known, new = {}, list(dict.fromkeys(keys))
            if model:
                for k, c in zip(new, model.chances(new).tolist()):
                    known[k] = (c, slots(*k), shown(k[0])) if c >= DOUBT else (c, False, None)
            else:
                for k in new:
                    slot, phrase = slots(*k), shown(k[0])
                    known[k] = (float(slot or phrase is not None), slot, phrase)
            got = [known[k] for k in keys]
            cols = [b.column("src"), b.column("record_id"), b.column("sub_key"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.bool_()), pa.array([g[2] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCORED.split(", ")])

    return run


def scored(rows: DataFrame, model: Linear | None = None) -> DataFrame:
    """(src, record_id, sub_key, chance, slot, phrase) of each record with text.

    slot and phrase say, of what the model does not firmly call content, what shows it. Null and
    empty texts give no row. Without labelled rows of both kinds there is no model, and shapes and
    phrases decide alone. Repeated rows are scored each; an empty table gives an empty result.
    """
    if model is None:
        model = fitted(rows)[0]
    texts = rows.where("record_id is not null and length(text) > 0").select("src", "record_id", "sub_key", "text", "masks_count")
    return spread(texts).mapInArrow(scorer(*((model.weights, model.bias) if model else (None, 0.0))), SCORED)


def residue(rows: DataFrame, model: Linear | None = None) -> DataFrame:
    """(src, record_id, sub_key) of the records to leave out, each once."""
    return scored(rows, model).where((F.col("chance") >= THRESHOLD) | (F.col("chance") >= DOUBT) & F.col("slot")).select("src", "record_id", "sub_key").distinct()


def validation(rows: DataFrame) -> DataFrame:
    """(measure, n): the figures of train() on the hosts that the model has not seen."""
    figures = fitted(rows)[1]
    return rows.sparkSession.createDataFrame(list(figures.items()), "measure string, n long")
