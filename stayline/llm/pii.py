"""Personal data: fixed patterns, and spans found by a character-level bidirectional LSTM with a CRF."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .mixing import draw, low_bits
from .recurrent import Adam, Both, LongShort
from .words import arrow_schema, batch_of, trimmed

# The kinds in their order. The first four have fixed patterns; secrets are learned from planted ones only.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

# What planted secrets are called, what stands between name and value, and around the value.
SECRET_NAMES = ("password", "passwd", "pwd", "secret", "api_key", "access_key", "auth", "credential", "private_key", "client_secret", "bearer", "session_id")
JOINTS = ("=", " = ", ": ", ":", " ", " := ", " is ")
QUOTES = ("", "'", '"')
# Beginnings, characters and lengths of planted secrets. Forty hexadecimal digits are not among them, for tests.
HEX, UPPER, LETTERS = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIGITS = HEX[:10]
SECRET_FORMS = (
    ("", HEX, (24, 28, 32, 36, 48, 56, 64)),
    ("", UPPER + LETTERS + DIGITS, (16, 20, 24, 32, 43, 48)),
    ("", UPPER + LETTERS + DIGITS + "+/", (22, 27, 44, 64, 88)),
    ("", LETTERS + DIGITS + "-_", (18, 26, 34)),
    ("AKIA", UPPER + DIGITS, (16,)),
    ("sk_live_", LETTERS + DIGITS, (24, 32)),
    ("ghp_", UPPER + LETTERS + DIGITS, (36,)),
)
#: What looks like a secret to a pattern. Where it is not planted its label is not known, and no window around it is learned from.
UNKNOWN = re.compile(r"(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}")

# Possessive forms of the base patterns: the same matches, without going back over long runs.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]++\Z")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")

#: Windows of characters: the stride is also what a window decides by itself.
WINDOW, STRIDE = 64, 32
#: The sample that the network learns from.
SAMPLE_DOCS, SAMPLE_WINDOWS = 1500, 6
HIDDEN, STEPS, BATCH, RATE = 16, 500, 96, 0.02
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
TOGETHER = 1024

Span = tuple[str, int, int]


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, from each `@`: what stands before it belongs to the first `@` behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Spans (kind, start, end) of the fixed patterns, by kind and start; matches that fail a test are dropped."""
    if not TRIGGER.search(text):
        return []
    out = [("email", *s) for s in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups())]
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


def symbols_of(text: str) -> np.ndarray:
    """A number for each character: ASCII as it is, other letters 128, the rest 129."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(codes < 128, codes, 129).astype(np.uint8)
    for i in np.flatnonzero(codes >= 128).tolist():
        out[i] = 128 if text[i].isalpha() else 129
    return out


SYMBOLS = 130


def tags_of(n: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(n, np.int64)
    for kind, start, end in spans:
        k = KINDS.index(kind)
        tags[start:end] = 2 + 2 * k
        tags[start] = 1 + 2 * k
    return tags


class Chain:
    """Emissions of the LSTM and a CRF over them. Tags: 0 outside, 1 + 2 k begins and 2 + 2 k goes on with kind k."""

    def __init__(self, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.layer = Both(LongShort, SYMBOLS, hidden, rng)
        self.w = rng.normal(0, 0.1, (TAGS, 2 * hidden)).astype(np.float32)
        self.b = np.zeros((TAGS, 1), np.float32)
        self.move = np.zeros((TAGS, TAGS), np.float32)
        # an inside tag goes on with its own kind only
        self.allowed = np.array([[b == 0 or b % 2 == 1 or a in (b, b - 1) for b in range(TAGS)] for a in range(TAGS)])

    def transitions(self) -> np.ndarray:
        return np.where(self.allowed, self.move, -1e4).astype(np.float64)

    def gradients(self, x: np.ndarray, on: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Negative log-likelihood of the tags, and its gradients, by the forward-backward algorithm."""
        states, backward = self.layer.learn(x, on)
        emit = (self.w @ states + self.b).astype(np.float64)
        move, (steps, n) = self.transitions(), x.shape
        ahead, back = np.zeros_like(emit), np.zeros_like(emit)
        ahead[0] = emit[0]
        for t in range(1, steps):
            new = _log_sum(ahead[t - 1][:, None, :] + move[:, :, None], 0) + emit[t]
            ahead[t] = np.where(on[t] > 0, new, ahead[t - 1])
        for t in range(steps - 2, -1, -1):
            old = _log_sum(move[:, :, None] + (emit[t + 1] + back[t + 1])[None], 1)
            back[t] = np.where(on[t + 1] > 0, old, back[t + 1])
        total = _log_sum(ahead[-1], 0)
        p = np.exp(ahead + back - total) * on[:, None]
        columns, gold = np.arange(n), np.zeros(n)
        d_move = np.zeros((TAGS, TAGS))
        d_emit = p
        for t in range(steps):
            gold += emit[t, tags[t], columns] * on[t]
            d_emit[t, tags[t], columns] -= on[t]
            if t:
                both = np.exp(ahead[t - 1][:, None] + move[:, :, None] + (emit[t] + back[t])[None] - total) * on[t]
                d_move += both.sum(axis=2)
                np.add.at(d_move, (tags[t - 1], tags[t]), -on[t])
                gold += move[tags[t - 1], tags[t]] * on[t]
        d_emit = (d_emit / n).astype(np.float32)
        grads = backward(np.einsum("kh,tkn->thn", self.w, d_emit))
        grads += [np.einsum("tkn,thn->kh", d_emit, states), d_emit.sum(axis=(0, 2))[:, None]]
        return float((total - gold).mean()), [*grads, (d_move * self.allowed / n).astype(np.float32)]

    def weights(self) -> list[np.ndarray]:
        return [*self.layer.weights(), self.w, self.b, self.move]

    def decode(self, x: np.ndarray, on: np.ndarray) -> np.ndarray:
        """The best tags (time, windows) by Viterbi; positions that are off repeat the last tag."""
        ahead, back = self.layer.run(x, on)
        k = ahead.shape[1]
        emit = np.matmul(self.w[:, :k], ahead) + np.matmul(self.w[:, k:], back) + self.b
        move, (steps, n) = self.transitions().astype(np.float32), x.shape
        starts = np.where(np.arange(TAGS) % 2 + (np.arange(TAGS) == 0), 0, -1e4).astype(np.float32)
        best = emit[0] + 0 * starts[:, None]
        came = np.zeros((steps, TAGS, n), np.int8)
        for t in range(1, steps):
            paths = best[:, None, :] + move[:, :, None]
            came[t] = paths.argmax(axis=0)
            new = paths.max(axis=0) + emit[t]
            live = on[t] > 0
            came[t][:, ~live] = np.arange(TAGS)[:, None]
            best = np.where(live, new, best)
        tags, columns = np.empty((steps, n), np.int64), np.arange(n)
        tags[-1] = best.argmax(axis=0)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = came[t, tags[t], columns]
        return tags


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis)
    return top + np.log(np.exp(a - np.expand_dims(top, axis)).sum(axis=axis))


def fit(samples: list[tuple[np.ndarray, np.ndarray]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 5) -> Chain:
    """Training on labelled windows (symbols, tags) by backpropagation through time; batches draw windows with a span half the time."""
    chain, rng = Chain(hidden, seed), np.random.default_rng(seed)
    x = np.zeros((WINDOW, len(samples)), np.uint8)
    on, tags = np.zeros((WINDOW, len(samples)), np.float32), np.zeros((WINDOW, len(samples)), np.int64)
    for j, (s, t) in enumerate(samples):
        x[: len(s), j], on[: len(s), j], tags[: len(s), j] = s, 1, t
    marked = (tags > 0).any(axis=0)
    pools = [p for p in (np.flatnonzero(marked), np.flatnonzero(~marked)) if len(p)]
    adam = Adam(chain.weights(), RATE)
    for step in range(steps):
        adam.rate = RATE * (1 - step / steps) + 0.001
        chosen = np.concatenate([rng.choice(p, BATCH // len(pools)) for p in pools])
        adam.step(chain.gradients(x[:, chosen], on[:, chosen], tags[:, chosen])[1])
    return chain


def window_starts(text: str) -> list[int]:
    """Windows on the grid of the text, a stride apart, that hold a digit or `@`: no reported span is without one."""
    grid = set()
    for m in TRIGGER.finditer(text):
        at = m.start() // STRIDE
        grid.update((at - 1, at))
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    return sorted({min(max(g, 0), last) * STRIDE for g in grid})


def plausible(kind: str, text: str) -> bool:
    """What a learned span of a kind must hold to be reported."""
    digits = len(digits_of(text))
    if kind == "email":
        return "@" in text and 0 < text.index("@") < len(text) - 3 and "." in text
    if kind == "secret":
        return len(text) >= 12 and digits > 0 and not any(c.isspace() for c in text) and any(c.isalpha() for c in text)
    return {"ip": 4 <= digits <= 12 and text.count(".") == 3, "card": 13 <= digits <= 19 and luhn(digits_of(text)), "phone": 8 <= digits <= 15}[kind]


def reconciled(tags: dict[int, np.ndarray], n: int) -> list[Span]:
    """Spans of a whole text from the tags of its windows: each character follows the window it lies most centrally in."""
    margin = (WINDOW - STRIDE) // 2
    whole = np.zeros(n, np.int64)
    depth = np.full(n, -1)
    for start, own in tags.items():
        end = min(n, start + WINDOW)
        inside = np.arange(end - start)
        near = np.minimum(inside + (margin if start == 0 else 0), WINDOW - 1 - inside + (margin if end == n else 0))
        better = near > depth[start:end]
        whole[start:end][better] = own[: end - start][better]
        depth[start:end][better] = near[better]
    spans, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (whole > 0).astype(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        at = a
        for i in range(a + 1, b + 1):
            if i == b or whole[i] % 2 == 1 or (whole[i] - 1) // 2 != (whole[at] - 1) // 2:
                spans.append((KINDS[(int(whole[at]) - 1) // 2], at, i))
                at = i
    return spans


def learned_spans(texts: list[str], chain: Chain) -> list[list[Span]]:
    """Spans that the network reports in each text."""
    symbols, places = [symbols_of(t) for t in texts], []
    for i, t in enumerate(texts):
        places += [(i, s) for s in window_starts(t)]
    found: list[dict[int, np.ndarray]] = [{} for _ in texts]
    for a in range(0, len(places), TOGETHER):
        part = places[a : a + TOGETHER]
        x, on = np.zeros((WINDOW, len(part)), np.uint8), np.zeros((WINDOW, len(part)), np.float32)
        for j, (i, s) in enumerate(part):
            own = symbols[i][s : s + WINDOW]
            x[: len(own), j], on[: len(own), j] = own, 1
        for (i, s), own in zip(part, chain.decode(x, on).T):
            found[i][s] = own
    return [[s for s in reconciled(f, len(t)) if plausible(s[0], t[s[1] : s[2]])] for f, t in zip(found, texts)]


def merged(base: list[Span], learned: list[Span]) -> list[Span]:
    """All base spans, and learned spans that touch none of them, by kind and start."""
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    reach = [0, *accumulate((e for _, e in taken), max)]  # the furthest end of the spans before each place
    free = [s for s in learned if reach[bisect_left(starts, s[2])] <= s[1]]
    return sorted([*base, *free], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def varied(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with spans rewritten as people also write them: phones without a country code, grouped cards."""
    parts, out, at, shift = [], [], 0, 0
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        if start < at:
            continue
        old = new = text[start:end]
        if kind == "phone" and rng.random() < 0.5:
            new = re.sub(r"^\+[0-9]+[ .-]*", "", old) or old
        if kind == "card" and rng.random() < 0.5 and old.isdigit():
            new = (" " if rng.random() < 0.5 else "-").join(old[i : i + 4] for i in range(0, len(old), 4))
        parts += [text[at:start], new]
        out.append((kind, start + shift, start + shift + len(new)))
        shift += len(new) - len(old)
        at = end
    return "".join([*parts, text[at:]]), out


def secret(rng: np.random.Generator) -> tuple[str, str]:
    """A name with a joint, and a made-up value that holds a digit and a letter."""
    name = str(rng.choice(SECRET_NAMES))
    name = name.upper() if rng.random() < 0.2 else name.title() if rng.random() < 0.2 else name
    before, characters, lengths = SECRET_FORMS[rng.integers(len(SECRET_FORMS))]
    value = rng.choice(list(characters), rng.choice(lengths))
    value[rng.integers(len(value))] = str(rng.integers(10))
    return name + str(rng.choice(JOINTS)), before + "".join(value) + ("" if any(c.isalpha() for c in before + "".join(value)) else "a")


def harmless(rng: np.random.Generator) -> str:
    """Text with digits that is nobody's: dates, times, versions, amounts, names of files, numbered words."""
    a, b, c = rng.integers(1, 13), rng.integers(10, 60), rng.integers(1900, 100_000)
    word = "".join(rng.choice(list(LETTERS), rng.integers(3, 9)))
    forms = (f"{c}-{a:02d}-{b % 28 + 1:02d}", f"{a}:{b}:{b}", f"v{a}.{b}.{a}", f"${c}.{b}", f"{word}_{c}.txt", f"https://{word}.org/{word}/{c}")
    return str(rng.choice([*forms, f"{word}{a}", f"{c},{b * 10 + 100}", f"({c})", f"{word}={c}", f'{word} = "{word}"', f"#{c}", f"{b}%", str(c) * 2]))


def planted(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with a secret and something harmless put between its words, outside spans."""
    for what in ("secret", "harmless") if rng.random() < 0.8 else ("harmless",):
        gaps = [m.start() for m in re.finditer(r"\s|\Z", text) if not any(s < m.start() < e for _, s, e in spans)]
        at = int(rng.choice(gaps))
        name, value = secret(rng) if what == "secret" else ("", harmless(rng))
        quote = str(rng.choice(QUOTES))
        before, after = f" {name}{quote}", quote + str(rng.choice(["", "", ".", ",", ";", "!!", "##"]))
        more = len(before) + len(value) + len(after)
        spans = [(k, s + more * (s >= at), e + more * (s >= at)) for k, s, e in spans]
        if what == "secret":
            spans.append(("secret", at + len(before), at + len(before) + len(value)))
        text = text[:at] + before + value + after + text[at:]
    return text, sorted(spans, key=lambda s: s[1])


def sample_reader(schema: pa.Schema, windows: int, seed: int):
    """Labelled windows (order, symbols, tags) from rows (order, text): around spans, around other digits and elsewhere.
    Windows that touch what may be a secret of the text's own are left out."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for order, text in zip(*(c.to_pylist() for c in batch.columns)):
                rng = np.random.default_rng([seed, int(order[:12], 16)])
                text, spans = planted(*varied(text, base_spans(text), rng), rng)
                unknown = [m.span() for m in UNKNOWN.finditer(text) if not any(s < m.end() and m.start() < e for _, s, e in spans)]
                symbols, tags = symbols_of(text), tags_of(len(text), spans)
                centres = [(s + e) // 2 for _, s, e in spans] + [m.start() for m in TRIGGER.finditer(text)] + [int(rng.integers(len(text)))]
                if len(centres) > windows:  # half of them around spans
                    first = rng.permutation(centres[: len(spans)])[: windows // 2].tolist()
                    near = first + rng.permutation(centres[len(spans) : -1])[: windows - 1 - len(first)].tolist()
                else:
                    near = centres[:-1]
                for i, c in enumerate([*near, centres[-1]]):
                    start = min(max(0, c - int(rng.integers(4, WINDOW - 4))), max(0, len(text) - WINDOW))
                    if any(a < start + WINDOW and start < b for a, b in unknown):
                        continue
                    own = tags[start : start + WINDOW].copy()
                    if len(own) and own[0] and own[0] % 2 == 0:  # the window cuts a span: its rest begins here
                        own[0] -= 1
                    out.append((f"{order}:{i:03d}", symbols[start : start + WINDOW].tobytes(), own.astype(np.uint8).tobytes()))
            yield batch_of(out, schema)

    return run


def train(docs: DataFrame, id_col: str, text_col: str, most: int, seed: int) -> Chain | None:
    """A chain from at most `most` times `SAMPLE_WINDOWS` windows of documents with a digit or `@`, the documents
    chosen by a keyed hash; None without any."""
    order = draw(seed, F.col(id_col), F.md5(F.col(text_col)))
    rows = docs.where(F.rlike(text_col, F.lit("[0-9@]"))).select(order.alias("order"), F.col(text_col).alias("text"))
    n = rows.count()
    if not n:
        return None
    near = rows.where(low_bits(F.col("order")) < F.lit(2 * most / n * (1 << 32)))
    # the part of a text around its spans is cut out by the tasks; what arrives is bounded
    ddl = "order string, symbols binary, tags binary"
    cut = near.mapInArrow(sample_reader(arrow_schema(ddl), SAMPLE_WINDOWS, seed), ddl)
    sample = cut.orderBy("order", "symbols").limit(most * SAMPLE_WINDOWS).toArrow()
    pairs = zip(sample["symbols"].to_pylist(), sample["tags"].to_pylist())
    return fit([(np.frombuffer(s, np.uint8), np.frombuffer(t, np.uint8).astype(np.int64)) for s, t in pairs], seed=seed)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def span_finder(chain: Chain | None, schema: pa.Schema):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda spans: [dict(zip(("kind", "start", "end"), s)) for s in spans]
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            base = [base_spans(t or "") for t in texts]
            open_ = [i for i, t in enumerate(texts) if chain and t and TRIGGER.search(t)]
            every = list(base)
            for a in range(0, len(open_), 256):
                part = open_[a : a + 256]
                for i, spans in zip(part, learned_spans([texts[i] for i in part], chain)):
                    every[i] = merged(base[i], spans)
            yield batch_of(zip(ids, map(as_rows, base), map(as_rows, every)), schema)

    return run


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS, seed: int = 5
) -> DataFrame:
    """(id, base, spans) for each row of `docs`: spans (kind, start, end) in code points, end exclusive, by kind and start.

    `base` holds the fixed patterns. `spans` adds those that a character-level bidirectional LSTM with a
    CRF reports, with a fifth kind, secrets (keys, tokens, passwords of 12 characters or more, with a digit and a letter).
    It learns from at most `sample` times `SAMPLE_WINDOWS` windows: base spans, some of them rewritten (phones without
    country code, grouped cards), and made-up secrets of several forms planted into the texts beside harmless
    numbers. What may be a secret of the text's own has no label and is not learned from. Whole texts are read in windows of 64 characters, 32
    apart; a character follows the window it lies most centrally in, and spans are put together over
    the whole text. A learned span must hold a digit or `@`, so only windows with one are decoded, and
    must hold what its kind needs; one that overlaps a base span goes.

    Null and empty texts have none. Rows are searched each. An empty table gives no rows.
    """
    chain = train(docs, id_col, text_col, sample, seed)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ddl = f"id {rows.schema['id'].dataType.simpleString()}, base {SPANS}, spans {SPANS}"
    return rows.mapInArrow(span_finder(chain, arrow_schema(ddl)), ddl)
