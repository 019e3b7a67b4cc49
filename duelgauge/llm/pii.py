"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions beside them.

The base finds emails, IPv4 addresses, card and phone numbers by pattern and check. The model reads
windows of characters around every digit and every @ (each kind it knows holds one of them), labels
characters with begin/inside tags per kind, and may add spans that the patterns miss, such as phone
numbers without a country code. Overlapping windows are decoded one by one; a character then takes the
tag of the window in which it lies furthest from an edge, and spans are read from the joined tags of the
whole text. Added spans need a high posterior probability and never touch a base span.

The model is trained in numpy from labelled spans: the base spans of at most `sample` of all texts that
hold some, as they are and with the changes of `varied`. Texts are the first in hash order for each kind,
kinds with few of them leaving their share to the others; a quarter of `sample` more hold a digit or @ but no
span. At most WINDOWS windows are learnt: one in BARE holds no span, the others are shared out by kind.

Defined cases: a null or empty text has no spans; texts are read whole, however long; equal windows are
computed once per batch; repeated rows are rows of their own; other columns are not read; if no
document at all holds a base span, the base alone is returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelgauge.llm.common import ship
from duelgauge.runtime import cut_lineage

KINDS = ("email", "ip", "card", "phone")
# The patterns of the four kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]+")
NOT_DIGIT = re.compile("[^0-9]")

WINDOW = 64
OVERLAP = 24
AROUND = 20
TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
SYMBOLS = 128 + 3
EMBED, HIDDEN = 12, 16
SAMPLE = 800
WINDOWS = 2_500
BARE = 5
STEPS = 450
BATCH = 96
SURE = 0.95
FORBIDDEN = -1e4

Span = tuple[int, int, int]  # start, kind, end
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind."""
    if not ANCHOR.search(text):
        return []
    out: list[Span] = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# --- windows -------------------------------------------------------------------------------------


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around anchors, cut into overlapping windows."""
    stretches: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = b
        else:
            stretches.append([a, b])
    out = []
    for a, b in stretches:
        while b - a > WINDOW:
            out.append((a, a + WINDOW))
            a += WINDOW - OVERLAP
        out.append((a, b))
    return out


def symbols(texts: list[str]) -> np.ndarray:
    """Character numbers, one row per window; 0 pads. Beyond ASCII only letter, space and other count."""
    out = np.zeros((len(texts), WINDOW), np.int64)
    for row, text in enumerate(texts):
        out[row, : len(text)] = [ord(c) if c < "\x80" else 128 if c.isalpha() else 129 if c.isspace() else 130 for c in text]
    return out


def tags_of(spans: list[Span], a: int, b: int) -> np.ndarray:
    """Tags of one window; spans that overlap another kind keep the first."""
    out = np.zeros(WINDOW, np.int64)
    for start, kind, end in spans:
        lo, hi = max(start, a) - a, min(end, b) - a
        if lo < hi and not out[lo:hi].any():
            out[lo:hi] = 2 + 2 * kind
            if start >= a:
                out[lo] = 1 + 2 * kind
    return out


def varied(text: str, spans: list[Span]) -> tuple[str, list[Span]]:
    """The same text with phone numbers without their country code and with a letter beyond ASCII in
    the first part of emails; the spans follow."""
    out, made, at = [], [], 0
    size = 0
    for start, kind, end in spans:
        if start < at:
            continue
        body = text[start:end]
        if kind == 3 and "(" in body:
            body = body[body.index("(") :]
        elif kind == 0:
            body = body[0] + "é" + body[1:]
        out += [text[at:start], body]
        size += start - at
        made.append((size, kind, size + len(body)))
        size += len(body)
        at = end
    return "".join([*out, text[at:]]), made


# --- the model -----------------------------------------------------------------------------------

Weights = dict[str, np.ndarray]


def new_weights(seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    made = {"embed": rng.normal(0, 0.3, (SYMBOLS, EMBED))}
    for side in ("f", "b"):
        made["in_" + side] = rng.normal(0, 0.3, (EMBED, 4 * HIDDEN))
        made["rec_" + side] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        made["bias_" + side] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])  # forget gate open
    made["out"] = rng.normal(0, 0.2, (2 * HIDDEN, TAGS))
    made["out_bias"] = np.zeros(TAGS)
    made["cross"] = np.zeros((TAGS, TAGS))
    return {k: v.astype(np.float32) for k, v in made.items()}


def allowed() -> np.ndarray:
    """0 where a tag may follow another, else a large penalty: inside follows begin or inside of its kind."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for kind in range(len(KINDS)):
        inside = 2 + 2 * kind
        out[:, inside] = FORBIDDEN
        out[[inside - 1, inside], inside] = 0
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def run_lstm(x: np.ndarray, rec: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """x: projected inputs (windows, steps, 4 gates). Gates: forget, input, output, candidate."""
    n, steps, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, tape = np.empty((n, steps, HIDDEN), np.float32), []
    for t in range(steps):
        z = x[:, t] + h @ rec
        gates = sigmoid(z[:, : 3 * HIDDEN])
        f, i, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before = (h, c)
        c = f * c + i * g
        squashed = np.tanh(c)
        h = o * squashed
        out[:, t] = h
        if keep:
            tape.append((before, f, i, o, g, squashed))
    return out, tape


def lstm_slopes(d_out: np.ndarray, tape: list, rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients for the projected inputs and the recurrent weights."""
    n, steps, _ = d_out.shape
    dx = np.empty((n, steps, 4 * HIDDEN), np.float32)
    d_rec = np.zeros_like(rec)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        (h0, c0), f, i, o, g, squashed = tape[t]
        dh = dh + d_out[:, t]
        dc = dc + dh * o * (1 - squashed * squashed)
        dz = np.concatenate([dc * c0 * f * (1 - f), dc * g * i * (1 - i), dh * squashed * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dx[:, t] = dz
        d_rec += h0.T @ dz
        dh, dc = dz @ rec.T, dc * f
    return dx, d_rec


def emissions(w: Weights, x: np.ndarray, keep: bool = False):
    """Tag scores of every character; the backward pass sees padding first, which it can learn to ignore."""
    e = w["embed"][x]
    forward, tape_f = run_lstm(e @ w["in_f"] + w["bias_f"], w["rec_f"], keep)
    backward, tape_b = run_lstm((e @ w["in_b"] + w["bias_b"])[:, ::-1], w["rec_b"], keep)
    states = np.concatenate([forward, backward[:, ::-1]], axis=2)
    return states @ w["out"] + w["out_bias"], (e, states, tape_f, tape_b)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def posteriors(scores: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of tags (windows, steps, tags) and expected numbers of transitions, by forward-backward."""
    n, steps, k = scores.shape
    ahead, back = np.empty((n, steps, k), np.float32), np.zeros((n, steps, k), np.float32)
    ahead[:, 0] = scores[:, 0]
    for t in range(1, steps):
        ahead[:, t] = scores[:, t] + log_sum(ahead[:, t - 1, :, None] + cross[None], 1)
    for t in range(steps - 2, -1, -1):
        back[:, t] = log_sum(cross[None] + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
    total = log_sum(ahead[:, -1], 1)
    pairs = np.zeros((k, k), np.float32)
    for t in range(1, steps):
        joint = ahead[:, t - 1, :, None] + cross[None] + (scores[:, t] + back[:, t])[:, None, :] - total[:, None, None]
        pairs += np.exp(np.minimum(joint, 0)).sum(0)
    return np.exp(np.minimum(ahead + back - total[:, None, None], 0)), pairs


def best_tags(scores: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """The most probable tag sequence of every window."""
    n, steps, k = scores.shape
    score, come = scores[:, 0], np.zeros((n, steps, k), np.int8)
    for t in range(1, steps):
        ways = score[:, :, None] + cross[None]
        come[:, t] = ways.argmax(1)
        score = ways.max(1) + scores[:, t]
    out = np.empty((n, steps), np.int64)
    out[:, -1] = score.argmax(1)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = come[np.arange(n), t, out[:, t]]
    return out


def slopes(w: Weights, x: np.ndarray, tags: np.ndarray) -> Weights:
    """Gradient of the mean negative log likelihood of the tags."""
    scores, (e, states, tape_f, tape_b) = emissions(w, x, keep=True)
    cross = w["cross"] + allowed()
    probable, pairs = posteriors(scores, cross)
    n = len(x)
    d = probable
    d[np.arange(n)[:, None], np.arange(WINDOW)[None, :], tags] -= 1
    d /= n
    seen = np.zeros((TAGS, TAGS), np.float32)
    np.add.at(seen, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    flat = d.reshape(-1, TAGS)
    out = {"cross": (pairs - seen) / n, "out": states.reshape(-1, 2 * HIDDEN).T @ flat, "out_bias": flat.sum(0)}
    d_states = d @ w["out"].T
    de = np.zeros_like(e)
    for side, part, tape in (("f", d_states[:, :, :HIDDEN], tape_f), ("b", d_states[:, ::-1, HIDDEN:], tape_b)):
        dx, out["rec_" + side] = lstm_slopes(part, tape, w["rec_" + side])
        dx = dx if side == "f" else dx[:, ::-1]
        flat_x = dx.reshape(-1, 4 * HIDDEN)
        out["bias_" + side] = flat_x.sum(0)
        out["in_" + side] = e.reshape(-1, EMBED).T @ flat_x
        de += dx @ w["in_" + side].T
    out["embed"] = np.zeros_like(w["embed"])
    np.add.at(out["embed"], x.ravel(), de.reshape(-1, EMBED))
    return out


def fit(x: np.ndarray, tags: np.ndarray, steps: int = STEPS, seed: int = 5) -> Weights:
    """Adaptive moment steps over shuffled batches."""
    w, rng = new_weights(seed), np.random.default_rng(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    while step < steps:
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            grads = slopes(w, x[part], tags[part])
            step += 1
            for k, g in grads.items():
                g = np.clip(g, -5, 5)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                w[k] = w[k] - 0.025 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return w


# --- finding -------------------------------------------------------------------------------------


def reconciled(text: str, cuts: list[tuple[int, int]], tags: list[np.ndarray], sure: list[np.ndarray]) -> list[Span]:
    """Spans of a whole text: every character takes the tag of the window that holds it deepest."""
    chosen: dict[int, tuple[int, int, float]] = {}
    for (a, b), tag, p in zip(cuts, tags, sure):
        for k in np.flatnonzero(np.arange(WINDOW) < b - a).tolist():
            depth = min(k if a else WINDOW, b - a - 1 - k if b < len(text) else WINDOW)
            if a + k not in chosen or chosen[a + k][0] < depth:
                chosen[a + k] = (depth, int(tag[k]), float(p[k]))
    out: list[Span] = []
    start = kind = None
    last, least = -2, 1.0
    for place in [*sorted(chosen), len(text) + 1]:
        _, tag, p = chosen.get(place, (0, 0, 1.0))
        here = (tag - 1) // 2 if tag else None
        if start is not None and (place != last + 1 or here != kind or tag % 2 == 1):
            if least >= SURE:
                out.append((start, kind, last + 1))
            start = None
        if here is not None:
            if start is None:
                start, kind, least = place, here, 1.0
                if tag % 2 == 0:  # an inside tag without its begin
                    least = 0.0
            least = min(least, p)
        last = place
    return out


def model_spans(w: Weights, texts: list[str]) -> list[list[Span]]:
    """Spans that the model finds in each text; equal windows are computed once."""
    cuts = [windows(t) for t in texts]
    known: dict[str, int] = {}
    for text, own in zip(texts, cuts):
        for a, b in own:
            known.setdefault(text[a:b], len(known))
    if not known:
        return [[] for _ in texts]
    tags, sure = np.empty((len(known), WINDOW), np.int64), np.empty((len(known), WINDOW), np.float32)
    strings, cross = list(known), w["cross"] + allowed()
    for at in range(0, len(strings), 512):
        scores, _ = emissions(w, symbols(strings[at : at + 512]))
        tags[at : at + 512] = best_tags(scores, cross)
        probable, _ = posteriors(scores, cross)
        sure[at : at + 512] = np.take_along_axis(probable, tags[at : at + 512, :, None], 2)[:, :, 0]
    out = []
    for text, own in zip(texts, cuts):
        rows = [known[text[a:b]] for a, b in own]
        out.append(reconciled(text, own, [tags[r] for r in rows], [sure[r] for r in rows]) if any(tags[r].any() for r in rows) else [])
    return out


def plausible(kind: int, body: str) -> bool:
    """What a found span must hold: the checks of its kind, so that numbers that fail them stay alone."""
    digits = NOT_DIGIT.sub("", body)
    if kind == 0:
        return "@" in body[1:-1]
    if kind == 1:
        parts = body.split(".")
        return len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


def joined(base: list[Span], found: list[Span]) -> list[Span]:
    """Base spans and those found spans that touch none of them."""
    extra = [s for s in found if all(s[2] <= a or b <= s[0] for a, _, b in base)] if base else found
    return sorted([*base, *extra])


def shares(counts: list[int], total: int) -> list[int]:
    """Equal shares of a total, none above its count; what one does not need goes to the others."""
    out = [0] * len(counts)
    for done, k in enumerate(sorted(range(len(counts)), key=lambda k: counts[k])):
        out[k] = min(counts[k], (total - sum(out)) // (len(counts) - done))
    return out


def sampled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Distinct texts to learn from, drawn by hash order from all texts with base spans of each kind, and from those without."""
    ship(__name__)
    limits = [sample] * len(KINDS) + [sample // 4]

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first texts of each kind in this task: no more can be among the first of all."""
        held: list[dict[str, int]] = [{} for _ in limits]
        last: list[tuple[int, str] | None] = [None] * len(limits)

        def cut(k: int) -> None:
            first = sorted((h, t) for t, h in held[k].items())[: limits[k]]
            held[k] = {t: h for h, t in first}
            last[k] = first[-1] if first and len(first) == limits[k] else None

        for batch in batches:
            for text, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist()):
                for k in {kind for _, kind, _ in base_spans(text)} or {len(KINDS)}:
                    if last[k] is None or (h, text) < last[k]:
                        held[k][text] = h
                        if len(held[k]) > 2 * limits[k]:
                            cut(k)
        for k in range(len(limits)):
            cut(k)
            texts = list(held[k])
            for at in range(0, len(texts), 200):
                part = texts[at : at + 200]
                yield pa.RecordBatch.from_pydict(
                    {"kind": pa.array([k] * len(part), pa.int32()), "h": pa.array([held[k][t] for t in part], pa.int64()), "text": pa.array(part, pa.string())}
                )

    some = docs.select("text", F.xxhash64("text").alias("h")).filter(F.col("text").rlike("[0-9@]"))
    first = cut_lineage(some.mapInArrow(pick, "kind int, h long, text string"))
    texts = [first.filter(F.col("kind") == k).select("h", "text").distinct().orderBy("h", "text").limit(n) for k, n in enumerate(limits)]
    counts = {r["kind"]: r["n"] for r in first.groupBy("kind").agg(F.count_distinct("text").alias("n")).collect()}  # five rows
    quota = shares([min(counts.get(k, 0), sample) for k in range(len(KINDS))], sample)
    out = texts[-1]
    for k, n in enumerate(quota):
        out = out.unionByName(texts[k].limit(n))
    return out.select("text").distinct()


def to_learn(texts: DataFrame) -> DataFrame:
    """Labelled windows: text, tags and kind (-1: no span)."""

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, marks, kinds = [], [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                for t, s in [(text, spans)] + ([varied(text, spans)] if spans else []):
                    for a, b in windows(t):
                        cuts.append(t[a:b])
                        marks.append(tags_of(s, a, b).astype(np.int8).tobytes())
                        kinds.append(next((kind for start, kind, end in s if end > a and start < b), -1))
            yield pa.RecordBatch.from_pydict({"text": pa.array(cuts, pa.string()), "tags": pa.array(marks, pa.binary()), "kind": pa.array(kinds, pa.int32())})

    cut = texts.mapInArrow(label, "text string, tags binary, kind int").distinct().withColumn("h", F.xxhash64("text"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("h", "text", "tags"))
    ranked = cut.withColumn("rank", rank).filter(F.when(F.col("kind") < 0, F.col("rank") <= WINDOWS // BARE).otherwise(F.col("rank") <= WINDOWS))
    held = ranked.filter("kind >= 0").orderBy("rank", "h", "text", "tags").limit(WINDOWS - WINDOWS // BARE)
    return held.unionByName(ranked.filter("kind < 0")).select("text", "tags", "kind")


def train(docs: DataFrame, sample: int = SAMPLE) -> Weights | None:
    """Fit on base spans of a bounded sample of documents; only the weights come to the driver."""

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((row for batch in batches for row in batch.to_pylist()), key=lambda row: (row["text"], row["tags"]))
        if any(row["kind"] >= 0 for row in found):
            marks = np.array([np.frombuffer(row["tags"], np.int8) for row in found], np.int64)
            w = fit(symbols([row["text"] for row in found]), marks)
            raw = pa.array([v.astype("<f4").tobytes() for v in w.values()], pa.binary())
            yield pa.RecordBatch.from_pydict({"name": list(w), "raw": raw})

    # One task trains: its input is bounded, and workers run single-threaded linear algebra.
    few = to_learn(cut_lineage(sampled(docs, sample))).coalesce(1)
    learned = few.mapInArrow(learn, "name string, raw binary").collect()
    shapes = {k: v.shape for k, v in new_weights(0).items()}
    return {r["name"]: np.frombuffer(r["raw"], "<f4").reshape(shapes[r["name"]]) for r in learned} or None


def find(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: numbers of base spans, digest of the base spans, and all spans."""
    ship(__name__)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample))  # some thousand numbers

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                found = model_spans(w, texts) if w else [[] for _ in texts]
                columns = {"doc_id": part.column("doc_id").cast(pa.int64())}
                for k, kind in enumerate(KINDS):
                    columns[f"n_{kind}"] = pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64())
                columns["base_sha256"] = [hashlib.sha256(written(b).encode()).hexdigest() for b in base]
                columns["spans"] = [written(joined(b, [s for s in f if plausible(s[1], t[s[0] : s[2]])])) for t, b, f in zip(texts, base, found)]
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(search, SCHEMA)
