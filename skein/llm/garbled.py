"""Garbled text from wrong character encoding.

Characters are mapped back to the bytes of a legacy encoding, an automaton of the UTF-8 byte
structure finds maximal runs of well-formed multibyte sequences among them, and only those runs
are decoded. This repeats while it finds something, so text garbled twice is restored too. Text
that was legacy bytes to begin with, read as another legacy encoding or as UTF-8, shows C1
controls or replacement characters; the first are mapped back, the second are reported as lost.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import spread

#: The legacy encodings text is read in by mistake, in order of preference.
CODECS = ("cp1252", "mac_roman", "cp437", "cp1251", "cp850", "cp1250", "iso8859_15")
LOST = "�"


def _bytes_of(codec: str) -> dict[str, int]:
    """Char -> byte of a codec's upper half; bytes a codec leaves open stand for themselves."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0x100):
        out.setdefault(chr(b), b) if codec == "cp1252" else None
    for b in range(0x80, 0xA0):
        out.setdefault(chr(b), b)
    return out


BYTES = {c: _bytes_of(c) for c in CODECS}


def _class(codec: str, lo: int, hi: int) -> str:
    return "[" + "".join(re.escape(ch) for ch, b in BYTES[codec].items() if lo <= b <= hi) + "]"


N = len(CODECS)
LEADS, BARE, LETTER, SURE = (1 << N) - 1, 1 << 2 * N, 1 << 2 * N + 1, 1 << 2 * N + 2


def _classes() -> np.ndarray:
    """Bits of each character: a lead in codec k (bit k), a trail in it (bit N + k), a mark of garbling by itself."""
    out = np.zeros(0x110000, np.uint32)
    for k, table in enumerate(BYTES.values()):
        for ch, b in table.items():
            out[ord(ch)] |= 1 << k if 0xC2 <= b <= 0xF4 else 1 << N + k if b <= 0xBF else 0
    out[[0xC2, 0xC3]] |= BARE
    for lo, hi in ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)):
        out[lo : hi + 1] |= LETTER
    out[0x80:0xA0] |= SURE
    out[0xFFFD] |= SURE
    return out


CLASSES = _classes()
CHUNK = 1 << 20  # characters that are classified at once; a longer text is a chunk of its own


def candidates(texts: list[str | None]) -> list[int]:
    """Places of the texts that could be garbled: a lead stands before a trail of its codec, or a mark stands alone.

    All others are clean by examine(). Whole chunks of texts are classified by one table lookup.
    """
    out: list[int] = []

    def flush(at: list[int]) -> None:
        if not at:
            return
        code = np.frombuffer("\n".join([*(texts[i] for i in at), ""]).encode("utf-32-le"), np.uint32)
        kind = CLASSES[code]
        first, then = kind[:-1], kind[1:]
        hit = (first & SURE) | (first & (then >> N) & LEADS) | ((first & BARE) & ~((then & LETTER) >> 1))
        ends = np.cumsum([len(texts[i]) + 1 for i in at])
        out.extend(at[k] for k in np.unique(np.searchsorted(ends, np.flatnonzero(hit), "right")))

    some, size = [], 0
    for i, t in enumerate(texts):
        if not t or t.isascii():
            continue
        if size + len(t) > CHUNK:
            flush(some)
            some, size = [], 0
        some.append(i)
        size += len(t)
    flush(some)
    return out


STARTS = {c: re.compile(_class(c, 0xC2, 0xF4) + _class(c, 0x80, 0xBF)) for c in CODECS}

#: The automaton: state -> list of (lowest byte, highest byte, next state); 0 is between sequences.
AUTOMATON = {
    0: [(0xC2, 0xDF, 1), (0xE0, 0xE0, 2), (0xE1, 0xEC, 3), (0xED, 0xED, 4), (0xEE, 0xEF, 3), (0xF0, 0xF0, 5), (0xF1, 0xF3, 6), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)],
    2: [(0xA0, 0xBF, 1)],
    3: [(0x80, 0xBF, 1)],
    4: [(0x80, 0x9F, 1)],
    5: [(0x90, 0xBF, 3)],
    6: [(0x80, 0xBF, 3)],
    7: [(0x80, 0x8F, 3)],
}
NEXT = {s: {b: t for lo, hi, t in rows for b in range(lo, hi + 1)} for s, rows in AUTOMATON.items()}


def spans(text: str, codec: str) -> list[tuple[int, int, str]]:
    """Maximal runs (start, end, decoded) of well-formed multibyte sequences under a codec."""
    table, out, at = BYTES[codec], [], 0
    while m := STARTS[codec].search(text, at):
        i, state, good, raw, kept = m.start(), 0, m.start(), bytearray(), 0
        while i < len(text) and (b := table.get(text[i])) is not None and b in NEXT[state]:
            state = NEXT[state][b]
            raw.append(b)
            i += 1
            if state == 0:
                good, kept = i, len(raw)
        if good > m.start():
            out.append((m.start(), good, bytes(raw[:kept]).decode("utf-8")))
        at = max(good, m.start() + 1)
    return out


def _common(ch: str) -> bool:
    """Characters that wrongly decoded European text is full of."""
    c = ord(ch)
    return 0xA0 <= c <= 0x17F or 0x300 <= c <= 0x36F or 0x2010 <= c <= 0x2044 or c in (0x20AC, 0x2122, 0x2116, 0x2212, 0xFE0F, 0xFEFF, 0xFFFD, 0x200B, 0x200D) or 0x1F300 <= c <= 0x1FAFF or 0x2190 <= c <= 0x27BF or 0x80 <= c <= 0x9F


def _script(ch: str) -> str:
    return unicodedata.name(ch, "?").split(" ")[0]


def plausible(text: str, span: tuple[int, int, str], codec: str) -> bool:
    """Whether a run is more likely garbled text than rightly written characters."""
    lo, hi, got = span
    was = text[lo:hi]
    before, after = text[lo - 1 : lo], text[hi : hi + 1]
    if any(unicodedata.category(c) in ("Cn", "Co") for c in got):
        return False
    if codec == "cp1251":  # a Cyrillic word that happens to start with a lead letter goes on in Cyrillic
        if any(c and _script(c) == "CYRILLIC" for c in (before, after)):
            return False
        if len(got) == 1 and not _common(got):
            return False
        return True
    if codec in ("mac_roman", "cp437", "cp850", "cp1250", "iso8859_15") and len(got) == 1 and len(was) == 2:
        # quotes, dashes and dots before a letter make pairs too; what they spell is no European letter
        if 0x300 <= ord(got) <= 0x36F and was[0] == "╠":  # a combining accent
            return True
        if not 0xA0 <= ord(got) <= 0x17F or codec == "mac_roman" and was[0] not in "¬√ƒ≈∆«»":
            return False
        if codec == "mac_roman" and was[0] in "«»" or codec == "cp437" and was[0] not in "┬├─┼" or codec == "cp850" and was[0] not in "┬├─┼":
            return False
        if codec in ("cp1250", "iso8859_15") and was[0] not in "ÂĂĹÄÃÅ":
            return False
        if was[0] in "─┼" and (before in "─│┼├┤" and before or after in "─│┼├┤" and after):
            return False
    if len(got) == 1 and not _common(got):
        # a lone rare character is more likely two right ones, such as a capital and a closing mark
        return len(was) >= 3 and codec in ("cp1252", "mac_roman", "cp437")
    if codec == "cp1252" and len(got) == 1 and len(was) == 2 and was[1] in "»”’“‘…–—" and was[0] in "ÉÈÀÊÇÔÙÁÍÓÚÜÖ":
        return False
    return True


def restore_once(text: str) -> str | None:
    """The text with the runs of the best codec decoded, or None where no codec finds any."""
    best: tuple[int, list] = (0, [])
    for c in CODECS:
        found = [s for s in spans(text, c) if plausible(text, s, c)]
        score = sum(hi - lo for lo, hi, _ in found)
        if score > best[0]:
            best = (score, found)
    if not best[1]:
        return None
    out, at = [], 0
    for lo, hi, got in best[1]:
        out += [text[at:lo], got]
        at = hi
    return "".join(out) + text[at:]


#: a lead char whose trail was lost, or was a no-break space that became a plain one
CUT = re.compile(r"(?<![A-ZÀ-Þ])Ã(?=\s|$|[?.,;!])|â€|Ãƒ|Ã¢|ï¿½|(?<![A-Za-zÀ-ÿ])Â(?=[\s£€°§©®½µ×]|$)")
C1 = re.compile(r"[\x80\x82-\x84\x86-\x8c\x8e\x91-\x9c\x9e\x9f]")
#: the same span of C1 controls in the two neighbours of Latin-1
SLOPPY = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def examine(text: str | None) -> tuple[bool, str | None, bool]:
    """(garbled, restored text, lossless). A null, empty or clean text is returned as it is."""
    if not text:
        return False, text, True
    now, lost, garbled = text, LOST in text, False
    while (new := restore_once(now)) is not None:  # each round shortens the text, so it ends
        now, garbled = new, True
    if CUT.search(now):
        garbled = lost = True
    if C1.search(now):
        now, garbled = "".join(SLOPPY.get(c, c) for c in now), True
        lost = lost or restore_once(now) is not None  # what now looks garbled was not restored
    return garbled or lost, now, not (lost or LOST in now)


def _find(batches):
    for b in batches:
        ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        got = [(ids[k], *examine(texts[k])) for k in candidates(texts)]
        got = [g for g in got if g[1]]
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.string()), pa.array([g[3] for g in got], pa.bool_())], names=["doc_id", "restored", "lossless"])


def garbled(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, restored, lossless) of every garbled text; restored keeps what could not be restored.

    lossless is false where characters were lost on the way. Null, empty and clean texts give no
    row, an empty table gives none; repeated rows come out as often as they are in the input.
    """
    d = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].alias("text"))
    return spread(d.where(F.col("text") != "")).mapInArrow(_find, "doc_id long, restored string, lossless boolean")
