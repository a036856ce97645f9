"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give base spans. The field segments the *chunks* of a text (words
with a digit, an at sign or a bracketed "at", joined over single blanks) into
whole spans of a kind and single tokens of none. Features describe a whole
candidate span: its shape, digits, checksum, separators and neighbours. Dynamic
programming over spans of at most ``LONGEST`` tokens picks boundaries and kinds
together; a span beyond the base ones is added if its marginal probability is at
least ``SURE`` and it touches no base span.

Trained on at most about ``SAMPLE_TEXTS`` texts with such chunks: base spans are the
truth, and rewritten copies of them (``(at)`` for ``@``, a phone number without
its plus, ...) teach the forms that patterns miss.

Defined results: NULL text is empty and has no spans. Offsets are code points,
ends exclusive. Rows are judged one by one, repeated or not. Without any base
span in the sample nothing is added.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_text, map_batches, map_rows

KINDS = ("email", "ip", "card", "phone")
LONGEST = 24
SURE = 0.9
SAMPLE_TEXTS = 4000
SAMPLE_CHUNKS = 2500
BUCKETS = 1 << 14
REACH = 64

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Digits are taken as whole runs, which changes no match and keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match needs the whole run of local characters before an at sign, so it
    is read backwards from there, down to the end of the match before."""
    end, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            yield lo, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "@" in text:
        out += [("email", lo, hi) for lo, hi in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        # a number of more than three digits may only have zeros before them
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


_TRIGGER = re.compile(r"[0-9@]+|[(\[](?:at|AT)[)\]]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")


def chunks(text: str) -> list[tuple[int, int]]:
    """Ranges to segment: words with a trigger, at most ``REACH`` characters
    beyond it, joined over one blank."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        lo, hi = m.span()
        if out and hi <= out[-1][1]:
            continue
        low, high = max(0, lo - REACH), min(len(text), hi + REACH)
        while lo > low and not text[lo - 1].isspace():
            lo -= 1
        while hi < high and not text[hi].isspace():
            hi += 1
        if out and lo <= out[-1][1] + 1 and (lo <= out[-1][1] or text[out[-1][1]] == " "):
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


class Chunk:
    """Tokens of a chunk and its candidate spans with their feature rows."""

    def __init__(self, text: str) -> None:
        self.tokens = _TOKEN.findall(text)
        self.starts = [0]
        for t in self.tokens:
            self.starts.append(self.starts[-1] + len(t))
        n = len(self.tokens)
        useful = [t[0].isascii() and t[0].isalnum() for t in self.tokens]
        self.ends: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            if useful[i] or self.tokens[i] in "+(":
                for j in range(i + 1, min(n, i + LONGEST) + 1):
                    if useful[j - 1]:
                        rows = self._features(text, i, j)
                        if rows is not None:
                            self.ends[j].append((i, rows))

    def _features(self, text: str, i: int, j: int) -> np.ndarray | None:
        lo, hi = self.starts[i], self.starts[j]
        span = text[lo:hi]
        digits = "".join(t for t in self.tokens[i:j] if t[0] in "0123456789")
        if not digits and "@" not in span and "at" not in span.lower():
            return None
        shape = "".join(("9" if t[0].isdigit() else "a") if t[0].isalnum() and t[0].isascii() else t
                        for t in self.tokens[i:j])
        sizes = "".join(str(min(len(t), 9)) if t[0].isalnum() else t for t in self.tokens[i:j])
        before = text[lo - 1] if lo else " "
        after = text[hi] if hi < len(text) else " "
        around = "".join("a" if c.isalnum() else c for c in (before, after))
        parts = span.replace("[.]", ".").split(".")
        last = self.tokens[j - 1]
        names = ["shape " + shape[:40], "sizes " + sizes[:40] if not shape.count("a") else "letters",
                 "around " + around, f"before {around[0]} {shape[0]}", f"after {around[1]} {shape[-1]}",
                 f"digits {min(len(digits), 20)}", f"at {span.count('@')} {'(at)' in span or '[at]' in span}",
                 f"plus {span[0] == '+'} {min(len(digits), 20)}", f"blanks {min(3, span.count(' '))}",
                 f"tail {last.isalpha()} {min(len(last), 8)}", f"dots {min(6, span.count('.'))}",
                 f"quads {len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)}",
                 f"check {13 <= len(digits) <= 19 and not shape.count('a') and luhn(digits)}"]
        return np.fromiter({zlib.crc32(x.encode()) % BUCKETS for x in names}, np.int64)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - np.expand_dims(safe, axis)).sum(axis=axis)) + safe


class Field:
    """Weights of kinds by feature, of a token outside any span, and between
    neighbouring kinds (the last is none)."""

    def __init__(self) -> None:
        self.w = np.zeros((BUCKETS, len(KINDS)))
        self.step = np.zeros((len(KINDS) + 1, len(KINDS) + 1))
        self.trained = False

    def _scores(self, chunk: Chunk) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every end the starts and the score of each kind."""
        return [(np.array([i for i, _ in ends], np.int64),
                 np.array([self.w[rows].sum(axis=0) for _, rows in ends]).reshape(len(ends), len(KINDS)))
                for ends in chunk.ends]

    def marginals(self, chunk: Chunk) -> tuple[float, list[np.ndarray], np.ndarray]:
        """Log normaliser, each candidate's probability per kind, and expected
        steps between kinds. Sums run over all segmentations."""
        n, k = len(chunk.tokens), len(KINDS)
        scored = self._scores(chunk)
        fore = np.full((n + 1, k + 1), -np.inf)  # last segment ends here with this kind
        into = np.full((n + 1, k + 1), -np.inf)  # a segment of this kind may start here
        fore[0, k] = 0.0
        into[0] = self.step[k]
        for j in range(1, n + 1):
            at, s = scored[j]
            if len(at):
                fore[j, :k] = _lse(into[at, :k] + s, 0)
            fore[j, k] = into[j - 1, k]
            into[j] = _lse(fore[j][:, None] + self.step, 0)
        total = float(_lse(fore[n], 0))
        back = np.full((n + 1, k + 1), -np.inf)  # what follows a segment of this kind ending here
        back[n] = 0.0
        opens: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in range(n + 1)]
        for j in range(1, n + 1):
            for x, i in enumerate(scored[j][0]):
                opens[i].append((j, x, scored[j][1][x]))
        steps = np.zeros_like(self.step)
        for i in range(n - 1, -1, -1):
            then = np.full(k + 1, -np.inf)
            if opens[i]:
                then[:k] = _lse(np.array([s + back[j, :k] for j, _, s in opens[i]]), 0)
            then[k] = back[i + 1, k]
            back[i] = _lse(self.step + then[None, :], 1)
            steps += np.exp(fore[i][:, None] + self.step + then[None, :] - total)
        prob = [np.exp(into[at, :k] + s + back[j, :k] - total) if len(at) else s
                for j, (at, s) in enumerate(scored)]
        return total, prob, steps

    def learn(self, chunk: Chunk, gold: dict[tuple[int, int], int], rate: float) -> None:
        """One gradient step on the log-likelihood of the gold segmentation."""
        k = len(KINDS)
        _, prob, expected = self.marginals(chunk)
        for j, ends in enumerate(chunk.ends):
            for x, (i, rows) in enumerate(ends):
                g = -prob[j][x]
                if (i, j) in gold:
                    g = g.copy()
                    g[gold[i, j]] += 1
                if np.abs(g).max() > 1e-4:
                    self.w[rows] += rate * g
        seen, at, last = np.zeros_like(self.step), 0, k
        begin = {i: (j, y) for (i, j), y in gold.items()}
        while at < len(chunk.tokens):
            at, y = begin.get(at, (at + 1, k))
            seen[last, y] += 1
            last = y
        self.step += 0.1 * rate * (seen - expected)

    def decode(self, chunk: Chunk) -> list[tuple[int, int, int]]:
        """The best segmentation: (start, end, kind) of its spans."""
        n, k = len(chunk.tokens), len(KINDS)
        best = np.full((n + 1, k + 1), -np.inf)  # last segment ends here with this kind
        into = np.zeros((n + 1, k + 1))  # best way to start a segment of this kind here
        before = np.zeros((n + 1, k + 1), np.int64)
        begin = np.zeros((n + 1, k + 1), np.int64)
        into[0], before[0] = self.step[k], k
        scored = self._scores(chunk)
        for j in range(1, n + 1):
            at, s = scored[j]
            if len(at):
                ways = into[at, :k] + s
                x = np.argmax(ways, axis=0)
                best[j, :k], begin[j, :k] = ways[x, np.arange(k)], at[x]
            best[j, k], begin[j, k] = into[j - 1, k], j - 1
            ways = best[j][:, None] + self.step
            before[j] = np.argmax(ways, axis=0)
            into[j] = ways[before[j], np.arange(k + 1)]
        out, j, y = [], n, int(np.argmax(best[n]))
        while j > 0:
            i = int(begin[j, y])
            if y < k:
                out.append((i, j, y))
            j, y = i, int(before[i, y])
        return out[::-1]

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Spans of the best segmentation that are sure and touch no base span."""
        out: list[Span] = []
        if not self.trained:
            return out
        known = sorted((lo, hi) for _, lo, hi in base)
        for lo, hi in chunks(text):
            while known and known[0][1] <= lo:
                known.pop(0)
            taken = [x for x in itertools.takewhile(lambda x: x[0] < hi, known)]
            loose = (m for m in _TRIGGER.finditer(text, lo, hi)
                     if not any(s <= m.start() and m.end() <= t for s, t in taken))
            if next(loose, None) is None:  # nothing left to add here
                continue
            chunk = Chunk(text[lo:hi])
            got = self.decode(chunk)
            if not got:
                continue
            _, prob, _ = self.marginals(chunk)
            for i, j, y in got:
                x = next(x for x, (s, _) in enumerate(chunk.ends[j]) if s == i)
                a, b = lo + chunk.starts[i], lo + chunk.starts[j]
                if prob[j][x][y] >= SURE and not any(a < t and s < b for s, t in taken):
                    out.append((KINDS[y], a, b))
        return out


def rewrite(kind: str, span: str, rng: random.Random) -> str:
    """A form of a span that the patterns do not know."""
    if kind == "email":
        user, _, host = span.partition("@")
        return user + rng.choice(["(at)", "[at]", " (at) ", " [at] "]) + host
    if kind == "phone":
        plain = span[1:]
        return plain.split(" ", 1)[1] if " (" in plain and rng.random() < 0.5 else plain
    if kind == "ip":
        return span.replace(".", "[.]")
    digits = span.replace(" ", "").replace("-", "")
    return ".".join(digits[i:i + 4] for i in range(0, len(digits), 4))


def _harmless(rng: random.Random) -> str:
    """Numbers that are no personal data: dates, versions, amounts, times, keys."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice([
        f"{rng.randint(1500, 2100)}", f"{rng.randint(1900, 2100)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}:{d(2)}",
        f"{d(1)}.{d(1)}.{d(2)}", f"{d(1)}.{d(2)}", f"{d(1)},{d(3)},{d(3)}", f"{d(2)} {d(2)} {d(2)}", d(rng.randint(1, 24)),
        f"{d(4)} {d(4)}", f"({d(1)})", f"{d(1)}.{d(1)}.", f"{rng.randint(1900, 2100)}-{rng.randint(1900, 2100)}",
        hashlib.sha1(d(9).encode()).hexdigest(), f"v{d(1)}.{d(1)}.{d(1)}", f"{d(3)}%", f"${d(2)}.{d(2)}", f"[{d(2)}]",
        f"{d(5)} {d(3)} {d(5)} {d(4)}", f"@{rng.choice(['home', 'all', 'user'])}", f"{d(2)}/{d(2)}/{d(4)}"])


def _examples(text: str, rng: random.Random) -> Iterator[tuple[str, list[Span]]]:
    """Chunks of a text with their true spans, and rewritten copies."""
    base = base_spans(text)
    for lo, hi in chunks(text):
        inside = sorted((s - lo, t - lo, k) for k, s, t in base if lo <= s and t <= hi)
        inside = [x for x in inside if not any(y != x and y[0] < x[1] and x[0] < y[1] for y in inside)]
        piece = text[lo:hi]
        yield piece, [(k, s, t) for s, t, k in inside]
        for s, t, k in inside:
            other = rewrite(k, piece[s:t], rng)
            more = len(other) - (t - s)
            rest = [(y, a + more * (a >= t), b + more * (a >= t)) for a, b, y in inside if a != s]
            yield piece[:s] + other + piece[t:], [(k, s, t + more), *rest]


def train(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_chunks: int = SAMPLE_CHUNKS,
          epochs: int = 5, rate: float = 0.25) -> Field:
    """A field fitted on chunks of about ``sample_texts`` texts at most."""
    useful = id_text(docs).filter(F.col("text").rlike("[0-9@]"))
    n = useful.count()
    field = Field()
    if not n:
        return field

    def make():
        def one(text):
            for piece, spans in _examples(text, random.Random(zlib.crc32(text.encode()))):
                if len(piece) <= 160:
                    yield piece, ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        return one

    draw = F.pmod(F.xxhash64("text", F.lit(23)), F.lit(1_000_000)) / 1e6
    some = useful.filter(draw < min(1.0, sample_texts / n)).select("text").distinct()
    pieces = map_rows(some, make, "piece string, spans string").distinct()
    order = F.xxhash64("piece", F.lit(29))
    drawn = pieces.orderBy(F.col("spans") == "", order, "piece").limit(sample_chunks).collect()
    plain = pieces.filter("spans = ''").orderBy(order, "piece").limit(sample_chunks // 3).collect()
    examples = sorted({(r.piece, r.spans) for r in [*drawn, *plain]})
    if not any(s for _, s in examples):
        return field
    rng = random.Random(41)
    examples += [(_harmless(rng), "") for _ in range(sample_chunks // 3)]
    ready = []
    for piece, spans in examples:
        chunk = Chunk(piece)
        place = {p: i for i, p in enumerate(chunk.starts)}
        gold = {}
        for x in filter(None, spans.split(",")):
            kind, a, b = x.split(":")
            gold[place.get(int(a)), place.get(int(b))] = KINDS.index(kind)
        known = {(i, j) for j, ends in enumerate(chunk.ends) for i, _ in ends}
        if gold.keys() <= known:
            ready.append((chunk, gold))
    for epoch in range(epochs):
        rng.shuffle(ready)
        for chunk, gold in ready:
            field.learn(chunk, gold, rate / (1 + epoch))
    field.trained = True
    return field


def order(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, base and added spans (arrays of kind, start, end) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        model = shared.value

        def one(doc_id, text):
            base = base_spans(text or "")
            yield doc_id, order(base), order(model.spans(text or "", base))
        return one

    span = "array<struct<kind:string,start:int,end:int>>"
    return map_rows(id_text(docs), make, f"doc_id long, base {span}, added {span}")


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; spans that overlap become
    one mark of the kind that begins first."""
    out, at = [], 0
    for kind, lo, hi in sorted(spans, key=lambda s: (s[1], -s[2])):
        if lo >= at:
            out += [text[at:lo], f"[{kind.upper()}]"]
        at = max(at, hi)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """The documents with every span masked; n_chars, where there is one,
    follows the text. NULL text stays NULL."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        model = shared.value

        def masked(text):
            if text is None:
                return None
            base = base_spans(text)
            return mask(text, base + model.spans(text, base))

        def changed(batch):
            at = batch.schema.get_field_index("text")
            texts = [masked(t.as_py()) for t in batch.column(at)]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            size = batch.schema.get_field_index("n_chars")
            if size >= 0:
                field_ = batch.schema.field(size)
                batch = batch.set_column(size, field_, pa.array([None if t is None else len(t) for t in texts],
                                                                field_.type))
            return batch
        return changed

    return map_batches(docs, make)


def digest(found: DataFrame) -> DataFrame:
    def make():
        def one(doc_id, base, added):
            base = [tuple(s.values()) for s in base]
            say = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in order(spans))
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            every = base + [tuple(s.values()) for s in added]
            yield doc_id, *counts, hashlib.sha256(say(base).encode()).hexdigest(), say(every), len(added)
        return one

    return map_rows(found, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                 "base_sha256 string, spans string, n_added long")
