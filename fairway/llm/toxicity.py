"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two strings sums over all letter subsequences of length ``ORDER`` that both have, each
weighted by ``DECAY`` to the power of the spans it takes, so that gaps and inserted letters cost a little
and do not break a match.  A text is seen through short units: each word's beginnings (endings vary) and
windows, marks standing for a word's start and end, and runs of single letters joined.  Landmarks are units
chosen from the labelled sentences; the kernel of a unit with all landmarks, whitened, is its feature vector,
and a hinge-loss model separates units of insults from others.  A text's score comes from its most toxic unit and
from how many there are, in all and by its length: a rare word may look like an insult by chance.

Only texts, not units, are labelled, so units are first found by how much more often they occur in toxic texts,
and the hardest units of other texts are then taken as counterexamples, twice.  The curve of the scores is fitted
on texts that the units were not learned from.  Units that lack letters of every insult learned (more than one, of
those of more than five letters) are far from all of them and get the lowest margin without a kernel.

The model is fitted on a bounded sample: at most ``SAMPLE`` labelled documents of each class outside the
held-out fold.  ``VARIANTS``, ``CLEAN`` and ``LANDMARKS`` bound the model's own size (forms of insults, other units
and landmarks it is made of), not what it reads.  Every text is scored whole.
"""

from __future__ import annotations

import io
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, linear

ORDER, DECAY = 3, 0.6
WINDOW, STEP = 10, 3
BEGINNINGS = (5, 6, 8)
LANDMARKS, VARIANTS, CLEAN = 64, 400, 600
#: An insult occurs at least so many times as often, by length of text, in toxic texts; of one text so many count.
RATIO, OF_ONE_TEXT = 8.0, 3
#: A word counts as an insult from this far below the margin's 0 on, in part up to 1 above that.
SOFT = 0.75
FLOOR = -2.0
SAMPLE = {1: 2500, 0: 4000}
THRESHOLD = 0.3
REMEMBERED = 400_000
#: Signs that are written for letters (fixed values).
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
_EDGES = ".,;:!?\"'()[]{}*$%&#|-_/<>"
_INNER = re.compile(r"[\W_]+")


def unit_words(text: str) -> Counter:
    """Lower-case words without outer signs and with inner signs removed, and how often; letters written apart are joined."""
    out, spelled = Counter(), []
    for token in tokens_of(text):
        if len(token) == 1:
            spelled.append(token)
            continue
        if len(spelled) > 2:
            out["".join(spelled)] += 1
        spelled = []
        out[token] += 1
    if len(spelled) > 2:
        out["".join(spelled)] += 1
    return out


def tokens_of(text: str) -> list[str]:
    return [t for t in (w.strip(_EDGES) for w in text.lower().split()) if t]


def plain(word: str) -> str:
    if word.isalpha():
        return word
    bare = _INNER.sub("", word)
    return bare if bare.isdigit() else bare.translate(LOOKALIKES)


def windows(word: str) -> list[str]:
    """The marked word's beginnings, and pieces of at most WINDOW letters that cover it."""
    marked = "^" + word + "$"
    out = [marked[:k] for k in BEGINNINGS if k < len(marked)] + [marked[:WINDOW]]
    if len(marked) > WINDOW:
        out += [marked[s : s + WINDOW] for s in (*range(STEP, len(marked) - WINDOW, STEP), len(marked) - WINDOW)]
    return out


def letters(words: list[str]) -> np.ndarray:
    """The set of letters of each word, as bits (letters may share a bit)."""
    out = np.zeros(len(words), np.uint64)
    for i, w in enumerate(words):
        bits = 0
        for c in w.strip("^$"):
            bits |= 1 << (ord(c) & 63)
        out[i] = bits
    return out


def _codes(words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), WINDOW), np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = [ord(c) for c in w]
    return out


#: The decay of the span from each place to a later one, in one string.
STEP_BACK = np.tril(DECAY ** np.subtract.outer(np.arange(WINDOW), np.arange(WINDOW)).clip(0).astype(np.float64), -1).T.astype(np.float32)


def _sum_over(same: np.ndarray) -> np.ndarray:
    """Of the match tables of many pairs: the weight of all common subsequences of length ORDER."""
    same = same.reshape(-1, WINDOW, WINDOW).astype(np.float32)
    ends = same  # weight of the common subsequences that end at each pair of places
    for _ in range(1, ORDER):
        for _ in range(2):  # onwards in one string, then in the other
            ends = (ends.reshape(-1, WINDOW) @ STEP_BACK).reshape(-1, WINDOW, WINDOW).transpose(0, 2, 1)
        ends = same * ends
    return ends.sum(axis=(1, 2)) * np.float32(DECAY * DECAY)


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Subsequence kernel of every row of a with every row of b (letter codes, 0 behind the end)."""
    same = (a[:, None, :, None] == b[None, :, None, :]) & (a[:, None, :, None] > 0)
    return _sum_over(same).reshape(len(a), len(b))


class Model:
    """Landmarks, their weights, and the curve that turns the features of a text into a probability."""

    def __init__(self, insults: list[str], landmarks: list[str], weights: np.ndarray, bias: float, curve: np.ndarray, telling: np.ndarray):
        self.telling = np.asarray(telling, np.float64)
        self.insults, self.landmarks, self.weights, self.bias, self.curve = insults, landmarks, weights, bias, np.asarray(curve, np.float64)
        self.sets = letters(insults)
        self.codes = _codes(landmarks)
        self.own = own_rows(self.codes)
        self.seen: dict[str, float] = {}

    def near(self, units: list[str]) -> list[str]:
        """Units that have all letters of some insult landmark, or all but one if it has more than five."""
        out = []
        spare = np.bitwise_count(self.sets) > 5
        for k in range(0, len(units), 4096):
            part = units[k : k + 4096]
            lacking = np.bitwise_count(self.sets[None, :] & ~letters(part)[:, None])
            out += [part[i] for i in np.flatnonzero((lacking <= spare).any(axis=1))]
        return out

    def margins(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The margin of each unit, and the insult that it is most like."""
        out, like = np.empty(len(units), np.float32), np.empty(len(units), np.int64)
        for k in range(0, len(units), 256):
            part = units[k : k + 256]
            values = normalized(_codes(part), self.codes, self.own)
            out[k : k + 256] = values @ self.weights + self.bias
            like[k : k + 256] = values[:, : len(self.insults)].argmax(axis=1)
        return out, like

    def of_words(self, words: list[str]) -> dict[str, tuple[float, int]]:
        """Best margin of each word's windows and the insult it is like; words met before are remembered up to a bound."""
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        new = [w for w in words if w not in self.seen]
        self.seen.update(dict.fromkeys(new, (FLOOR, -1)))
        marked = {w: f"^{plain(w)}$" for w in new} if self.insults else {}
        close = set(self.near(list(marked.values())))
        pieces = {w: windows(m[1:-1]) for w, m in marked.items() if m in close}
        distinct = self.near(list(dict.fromkeys(p for ps in pieces.values() for p in ps)))
        found = dict(zip(distinct, zip(*(x.tolist() for x in self.margins(distinct)))))
        for w, ps in pieces.items():
            self.seen[w] = max([(FLOOR, -1), *(found[p] for p in ps if p in found)])
        return self.seen

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: its best margin, how telling its insults are in all and at most, how many there are by its length, and 1."""
        split = [unit_words(t) for t in texts]
        margin = self.of_words(list(set().union(*split))) if split else {}
        out = np.empty((len(split), 5))
        for i, ws in enumerate(split):
            best, hits, told, most = FLOOR, 0.0, 0.0, 0.0
            for w, n in ws.items():
                m, like = margin[w]
                best = max(best, m)
                if m > -SOFT and like >= 0:
                    part = min(m + SOFT, 1.0)
                    hits += n * part
                    told += n * part * self.telling[like]
                    most = max(most, part * self.telling[like])
            out[i] = best, np.log1p(told), most, np.log((hits + 0.1) / (sum(ws.values()) + 20)), 1.0
        return out

    def probability(self, texts: list[str]) -> np.ndarray:
        return linear.sigmoid(self.features(texts) @ self.curve)

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, insults=np.array(self.insults, dtype=str), landmarks=np.array(self.landmarks, dtype=str), weights=self.weights, rest=np.array([self.bias, *self.curve]), telling=self.telling)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Model:
        got = np.load(io.BytesIO(data))
        return cls([str(x) for x in got["insults"]], [str(x) for x in got["landmarks"]], got["weights"].astype(np.float32), float(got["rest"][0]), got["rest"][1:], got["telling"])


def normalized(a: np.ndarray, b: np.ndarray, own_b: np.ndarray) -> np.ndarray:
    """kernel(a, b) / sqrt(kernel(a, a) * kernel(b, b))."""
    return kernel(a, b) / np.sqrt(own_rows(a)[:, None] * own_b[None, :])


def own_rows(a: np.ndarray) -> np.ndarray:
    """kernel(x, x) of every row."""
    return _sum_over((a[:, :, None] == a[:, None, :]) & (a[:, :, None] > 0)).clip(1e-9)


def _telling(counts: Counter, toxic: Counter, share: float) -> dict[str, float]:
    """Units that occur RATIO times as often in toxic texts, beyond chance for so many units.

    share: of all words, those in toxic texts; a unit counts if n * KL(its toxic share || share) is at least log(units) + 3.
    """
    least = np.log(len(counts) + 2) + 3
    out = {}
    for u, n in toxic.items():
        p = min(n / counts[u], 1 - 1e-9)
        if p / share >= RATIO * (1 - p) / (1 - share) and (kl := counts[u] * (p * np.log(p / share) + (1 - p) * np.log((1 - p) / (1 - share)))) >= least:
            out[u] = kl
    return out


def train(texts: list[bytes], labels: np.ndarray, seed: int = 5) -> bytes:
    """The packed model; its curve comes from texts that its units were not learned from."""
    toxic = labels == 1
    share = float((toxic.sum() + 1) / (len(labels) + 2))
    nothing = Model([], [], np.zeros(0, np.float32), 0.0, (0.0, 0.0, 0.0, 0.0, float(np.log(share / (1 - share)))), ())
    if not len(texts) or toxic.all() or not toxic.any():
        return nothing.pack()
    whole = [t.decode("utf-8", "replace") for t in texts]
    fold = np.arange(len(whole)) % 2
    features = np.empty((len(whole), 5))
    for k in (0, 1):
        learned = _units([whole[i] for i in np.flatnonzero(fold != k)], toxic[fold != k], seed)
        features[fold == k] = (learned or nothing).features([whole[i] for i in np.flatnonzero(fold == k)])
    model = _units(whole, toxic, seed)
    if model is None:
        return nothing.pack()
    model.curve = linear.logistic(features, np.where(toxic, 1, -1))
    return model.pack()


def _units(whole: list[str], toxic: np.ndarray, seed: int, rounds: int = 2) -> Model | None:
    """A model of units from labelled texts, without a curve; none if no unit tells toxic texts."""
    first = _without_copies(whole)
    words = [Counter() for _ in whole]
    for out, t in zip(words, whole):
        for w, n in unit_words(t).items():
            out[plain(w)] += n
    counts, bad = Counter(), Counter()
    lengths = [0, 0]
    for ws, t, own in zip(words, toxic, first):
        if own:
            # Words and their beginnings: endings vary.
            units = Counter()
            for w, n in ws.items():
                if len(w) >= ORDER:
                    units["^" + w + "$"] += n
                for k in (4, 5, 6):
                    if len(w) > k:
                        units["^" + w[:k]] += n
            units = {u: min(n, OF_ONE_TEXT) for u, n in units.items()}
            lengths[int(t)] += sum(ws.values())
            counts.update(units)
            if t:
                bad.update(units)
    share = (lengths[1] + 1) / (sum(lengths) + 2)
    insults: list[str] = []
    for u, kl in sorted(_telling(counts, bad, share).items(), key=lambda x: (-round(x[1], 1), -len(x[0]))):
        u = u[:WINDOW]
        if not any(u.startswith(v) or v.startswith(u) for v in insults):
            insults.append(u)
    if not insults:
        return None
    # How much more often words with this beginning occur in toxic texts, as a logarithm.
    often = np.full((2, len(insults)), 0.5)
    for ws, t, own in zip(words, toxic, first):
        if own:
            for w, n in ws.items():
                for i, u in enumerate(insults):
                    if f"^{w}$".startswith(u):
                        often[int(t), i] += n
    telling = np.log(often[1] / (lengths[1] + 1)) - np.log(often[0] / (lengths[0] + 1))
    reach = Model(insults, [], np.zeros(0, np.float32), 0.0, np.zeros(5), telling)
    units_of = lambda kind: {p for ws, t in zip(words, toxic) if t == kind for m in reach.near([f"^{w}$" for w in sorted(ws)]) for p in windows(m[1:-1])}
    begins = lambda p: any(p.startswith(u) for u in insults)
    clean = sorted(p for p in reach.near(sorted(units_of(False) - set(insults))) if not begins(p))
    variants = [p for p in sorted(units_of(True) - set(clean)) if begins(p)]
    rng = np.random.default_rng(seed)
    positives = insults + [p for p in (variants[i] for i in rng.permutation(len(variants))[:VARIANTS]) if p not in insults]
    positives += [p for u in insults for p in _roughened(u, rng) if p not in clean]
    hard = [clean[i] for i in rng.permutation(len(clean))[:CLEAN]]
    model = None
    for _ in range(rounds):
        marks = insults + _spread(hard[::-1], max(LANDMARKS - len(insults), LANDMARKS // 4))
        codes = _codes(marks)
        own = own_rows(codes)
        values, vectors = np.linalg.eigh(normalized(codes, codes, own).astype(np.float64))
        white = vectors / np.sqrt(np.maximum(values, 1e-3))
        units = positives + hard
        y = np.where(np.arange(len(units)) < len(positives), 1.0, -1.0)
        phi = np.concatenate([normalized(_codes(units[k : k + 256]), codes, own) for k in range(0, len(units), 256)]).astype(np.float64) @ white
        every = np.arange(phi.shape[1])
        w = linear.dual_descent([(every, row) for row in phi], y, phi.shape[1], np.where(y < 0, 20.0, np.where(np.arange(len(y)) < len(insults), 1000.0, 5.0)), epochs=60)
        model = Model(insults, marks, (white @ w[:-1]).astype(np.float32), float(w[-1]), np.zeros(5), telling)
        margins = model.margins(clean)[0]
        worst = np.argsort(-margins)[:400]
        hard = list(dict.fromkeys(hard + [clean[i] for i in worst if margins[i] > -1]))
    return model


def _roughened(unit: str, rng: np.random.Generator) -> list[str]:
    """The unit with one foreign letter put in, at each place behind its first letter."""
    return [(unit[:i] + "xqzkwyj"[rng.integers(7)] + unit[i:])[:WINDOW] for i in range(2, len(unit.rstrip("$")))] if len(unit) > 5 else []


def _without_copies(texts: list[str], hashes: int = 4) -> list[bool]:
    """False for texts that share a min-hash of their three-word shingles with an earlier one: copies would
    make all their words look telling."""
    import xxhash

    seen, out = set(), []
    for t in texts:
        ws = t.lower().split()
        shingles = np.array([xxhash.xxh64_intdigest(" ".join(ws[i : i + 3])) for i in range(max(1, len(ws) - 2))], np.uint64)
        marks = {(k, int((shingles * np.uint64(0x9E3779B97F4A7C15 + 2 * k) ^ (shingles >> np.uint64(29 + k))).min())) for k in range(hashes)}
        out.append(not marks & seen)
        seen |= marks
    return out


def _spread(units: list[str], n: int) -> list[str]:
    """n of the units, the first and then whichever is least like those taken."""
    units = units[:CLEAN]
    if n <= 0 or len(units) <= n:
        return units[: max(n, 0)]
    codes = _codes(units)
    own = own_rows(codes)
    nearest = np.full(len(units), -1.0, np.float32)
    taken = [0]
    while len(taken) < n:
        k = taken[-1]
        nearest = np.maximum(nearest, normalized(codes, codes[k : k + 1], own[k : k + 1])[:, 0])
        nearest[k] = 2
        taken.append(int(np.argmin(nearest)))
    return [units[i] for i in taken]


def fit(docs: DataFrame, labels: DataFrame, seed: int = 13) -> bytes:
    return linear.fit(linear.labelled_sample(docs, labels, "toxic", SAMPLE, seed), train)


def score(df: DataFrame, model: bytes, text_col: str = "text", out_col: str = "toxicity_score") -> DataFrame:
    """Adds ``out_col``: the probability that a text is toxic.

    Null counts as an empty text, which has no unit and so the lowest score.  Repeated rows have equal
    scores; an input column named like the output is replaced.
    """
    common.bound_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model.unpack(sent.value)
        for texts in batches:
            parts = []
            for k in range(0, len(texts), 500):
                parts.append(own.probability([(v.as_buffer().to_pybytes() if v.is_valid else b"").decode("utf-8", "replace") for v in texts.slice(k, 500)]))
            yield pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(out_col, F.arrow_udf(run, "double")(F.col(text_col).cast("binary")))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), fit(docs, labels), out_col="score")
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
