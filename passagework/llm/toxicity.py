"""Toxicity: subsequence string kernel, Nyström landmarks and a support vector machine."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import fresh, small_batches, without
from passagework.operators.common import join_sized, materialize

DECAY = 0.7  # per character skipped inside a subsequence
SPAN = 6  # characters that a subsequence of three may stretch over
#: Offsets of the second and third character, with the weight of their gaps.
SHAPES = [(a, b, DECAY ** (b - 2)) for b in range(2, SPAN) for a in range(1, b)]
FILTER_BITS = 20
WORDS_PER_STEP = 5_000
KNOWN_TOKENS = 250_000  # in each of two generations
SHARP = 0.2  # width of the exponential of the normalised kernel
NO_LETTER = re.compile(r"[\W\d_]+")
LEAST = 0.3  # normalised kernel values of whole words below count as none
HELD = 0.5  # the same for windows of longer words
ROOM = 3  # letters that a window may have more than the landmark
INSERTED = (1, 2, 3)  # letters put in the words of the spoiled copies of toxic texts
SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
STRETCHED = re.compile(r"(.)\1{2,}", re.S)
#: Scripts written without spaces: Thai to Myanmar, Khmer, kana, Han.
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]")


def words_of_token(token: str) -> set[str]:
    """The words that a lower-cased token stands for.

    Itself without marks and digits (``i.d-i0ot``: ``idiot``), what stands between them,
    and any of these with its runs of three or more equal letters shortened to one. In
    scripts without spaces also all windows of 2 to 4 characters.
    """
    if token.isalpha():
        words = {token}
    else:
        parts = [p for p in NO_LETTER.split(token) if p]
        words = {"".join(parts), *parts}
        words.discard("")
    words.update([STRETCHED.sub(r"\1", w) for w in words if len(w) > 2 and STRETCHED.search(w)])
    for w in [w for w in words if UNSPACED.search(w)]:
        words.update(w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1))
    return words


def tokens_of(text: str) -> set[str]:
    """Distinct tokens of a text, lower-cased; a run of three or more single characters (``i d i o t``) is also one."""
    lowered = text.lower()
    tokens = set(lowered.split())
    if any(len(t) == 1 and t.isalpha() for t in tokens):
        tokens.update(NO_LETTER.sub("", m[0]) for m in SPELLED.finditer(lowered))
        tokens.discard("")
    return tokens


def words_of(text: str) -> set[str]:
    """Distinct words of all tokens of a text."""
    return set().union(*map(words_of_token, tokens_of(text)))


def subsequences(words: list[str], start: str = "\x02", end: str = "\x03") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, key, weight) of every subsequence of three characters within ``SPAN``.

    Words are padded by a mark on both sides, so that starts and ends count. A key packs
    the three characters' UTF-16 units.
    """
    units = np.frombuffer("".join(f"\x00{start}{w}{end}" for w in words).encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.int64)
    word = np.cumsum(units == 0) - 1
    rows, keys, weights = [], [], []
    for a, b, weight in SHAPES:
        if len(units) <= b:
            continue
        same = (word[:-b] == word[b:]) & (units[:-b] != 0)
        at = np.flatnonzero(same)
        rows.append(word[at])
        keys.append((units[at] << 32) | (units[at + a] << 16) | units[at + b])
        weights.append(np.full(len(at), weight, np.float32))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(weights)


def summed(rows: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry per (word, key) with the sum of its weights, sorted by both."""
    order = np.lexsort((keys, rows))
    rows, keys, weights = rows[order], keys[order], weights[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])]) if len(rows) else np.empty(0, np.int64)
    return rows[first], keys[first], np.add.reduceat(weights, first) if len(first) else weights


def least_norm(letters: int) -> float:
    """Norm of an unmarked string without a repeated subsequence; with repeats it is larger."""
    return sum(max(0, letters - b) * weight**2 for _, b, weight in SHAPES) ** 0.5


class Kernel:
    """Kernel values between words and fixed landmark words.

    The gap-weighted subsequence kernel, normalised to 1 for equal words and sharpened by
    an exponential (which keeps it a kernel); far words have 0. A word longer than a landmark has the
    value of its best window, if that is higher.
    """

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        rows, keys, weights = summed(*subsequences(landmarks))
        norms = np.sqrt(np.bincount(rows, weights**2, len(landmarks)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.owner, self.share = rows[order], (weights / norms[rows])[order]
        self.sizes = np.array([len(m) for m in landmarks], int)
        self.floor = np.array([HELD * least_norm(len(m)) if len(m) > 3 else np.inf for m in landmarks])
        self.known = np.zeros(1 << FILTER_BITS, bool)
        self.known[self.slot(self.keys)] = True

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)

    def products(self, rows: np.ndarray, keys: np.ndarray, weights: np.ndarray, words: int) -> np.ndarray:
        """Sums over common subsequences, words x landmarks, divided by the landmark's norm."""
        size = len(self.landmarks)
        some = np.flatnonzero(self.known[self.slot(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        meets = self.keys[at] == keys[some]
        some, at = some[meets], at[meets]
        each = self.count[at]
        spot = np.repeat(self.first[at] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        cell = np.repeat(rows[some], each) * size + self.owner[spot]
        return np.bincount(cell, np.repeat(weights[some], each) * self.share[spot], words * size).reshape(-1, size)

    def sharpened(self, words: list[str], product: np.ndarray, square: np.ndarray, least: float, marks: tuple[str, ...]) -> np.ndarray:
        """Normalised and sharpened values; the exact norm only where a bound lets a word reach ``least``."""
        out = np.zeros(product.shape, np.float32)
        close = np.flatnonzero(product.max(1, initial=0) >= least * np.sqrt(square))
        if len(close):
            own_rows, _, own_weights = summed(*subsequences([words[i] for i in close], *marks))
            cosine = product[close] / np.sqrt(np.bincount(own_rows, own_weights**2, len(close)))[:, None]
            out[close] = np.where(cosine >= least, np.exp((np.minimum(cosine, 1) - 1) / SHARP), 0)
        return out

    def values(self, words: list[str]) -> np.ndarray:
        """Matrix words x landmarks; 1 for a landmark itself, 0 for words far from it."""
        return self.whole(words)[0]

    def whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys) or not words:
            return np.zeros((len(words), len(self.landmarks)), np.float32), np.zeros((len(words), len(self.landmarks)))
        rows, keys, weights = subsequences(words)
        # squares summed apart are at most the norm's square: what stays below ``LEAST`` here is below it
        square = np.maximum(np.bincount(rows, weights**2, len(words)), 1e-9)
        product = self.products(rows, keys, weights, len(words))
        return self.sharpened(words, product, square, LEAST, ()), product

    def best(self, words: list[str]) -> np.ndarray:
        """``values``, or those of the best window of a longer word, if they are higher.

        A window has a landmark's number of letters, or up to ``ROOM`` more, and no marks: what stands
        around it does not count. What a window shares with a landmark the word shares too, so a word
        whose own sum is below the least norm of such a window times ``HELD`` has none.
        """
        out, product = self.whole(words)
        if not len(self.keys) or not words:
            return out
        longer = np.array([len(w) for w in words])[:, None] > self.sizes
        pairs = np.argwhere(longer & (product >= self.floor))
        windows: dict[tuple[str, int], int] = {}
        owner, window = [], []
        for i, j in pairs.tolist():
            word, size = words[i], int(self.sizes[j])
            for n in range(size, min(size + ROOM, len(word)) + 1):
                for at in range(len(word) - n + 1):
                    owner.append((i, j))
                    window.append(windows.setdefault(word[at : at + n], len(windows)))
        names = list(windows)
        found = np.zeros((len(names), len(self.landmarks)), np.float32)
        for a in range(0, len(names), WORDS_PER_STEP):
            part = names[a : a + WORDS_PER_STEP]
            rows, keys, weights = subsequences(part, "", "")
            square = np.maximum(np.bincount(rows, weights**2, len(part)), 1e-9)
            found[a : a + len(part)] = self.sharpened(part, self.products(rows, keys, weights, len(part)), square, HELD, ("", ""))
        if owner:
            at = np.array(owner)
            np.maximum.at(out, (at[:, 0], at[:, 1]), found[window, at[:, 1]])
        return out


class Pool:
    """Highest kernel value of any word of a text, by landmark; remembers tokens, to a bound.

    Two generations: when the young one is full it becomes the old one, and a token found
    in the old one moves up. So frequent tokens stay, and rare ones are forgotten.
    """

    def __init__(self, kernel: Kernel):
        self.kernel = kernel
        self.none = np.zeros(len(kernel.landmarks), np.float32)
        self.young: dict[str, np.ndarray | None] = {}
        self.old: dict[str, np.ndarray | None] = {}

    def learn(self, tokens: list[str]) -> None:
        """Pooled values of new tokens; None for those far from all landmarks."""
        words: dict[str, int] = {}
        owner, member = [], []
        for i, token in enumerate(tokens):
            for word in words_of_token(token):
                owner.append(i)
                member.append(words.setdefault(word, len(words)))
        names = list(words)
        values = np.zeros((len(names), len(self.none)), np.float32)
        for a in range(0, len(names), WORDS_PER_STEP):
            values[a : a + WORDS_PER_STEP] = self.kernel.best(names[a : a + WORDS_PER_STEP])
        near = values.any(1)
        held: dict[int, np.ndarray] = {}
        for i, j in zip(owner, member):
            if near[j]:
                held[i] = np.maximum(held[i], values[j]) if i in held else values[j].copy()
        self.young.update((token, held.get(i)) for i, token in enumerate(tokens))

    def features(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), len(self.none)), np.float32)
        at = 0
        while at < len(texts):  # bounded steps: a text's tokens are met whole
            sets, new, start = [], set(), at
            while at < len(texts) and len(new) < WORDS_PER_STEP:
                tokens = tokens_of(texts[at].as_py() or "")
                sets.append(tokens)
                for token in tokens:
                    if token not in self.young:
                        if token in self.old:
                            self.young[token] = self.old[token]
                        else:
                            new.add(token)
                at += 1
            new_tokens = sorted(new)
            for a in range(0, len(new_tokens), WORDS_PER_STEP):
                self.learn(new_tokens[a : a + WORDS_PER_STEP])
            for i, tokens in enumerate(sets):
                rows = [row for row in map(self.young.__getitem__, tokens) if row is not None]
                if rows:
                    out[start + i] = np.max(rows, axis=0)
            if len(self.young) > KNOWN_TOKENS:
                self.young, self.old = {}, self.young
        return out


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # on kernel values: the machine's weights through the Nyström map
    bias: float
    scale: float
    shift: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        margin = features @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -40, 40)))


def word_labels(sample: DataFrame) -> DataFrame:
    """``word, toxic, clean``: in how many texts of either label each word stands."""

    def count(batches):
        for batch in batches:
            seen = (Counter(), Counter())
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                seen[label].update(words_of(text.as_py() or ""))
            words = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), *[pa.array([c[w] for w in words], pa.int64()) for c in (seen[1], seen[0])]], ["word", "toxic", "clean"]
            )

    each = sample.select("text", "label").mapInArrow(count, "word string, toxic long, clean long")
    return each.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def pick_landmarks(sample: DataFrame, landmarks: int, candidates: int = 1500) -> list[str]:
    """Words that set toxic texts apart, spread over the kernel's space.

    Candidates are the words with the highest standardised difference of their shares (3
    or more, in two toxic texts or more; at most ``candidates``). Landmarks are taken greedily: the next is the one with the
    highest difference times distance from those taken.
    """
    by_label = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = by_label.get(1, 0), by_label.get(0, 0)
    if not n1 or not n0:
        return []
    share = (F.col("toxic") + F.col("clean")) / (n1 + n0)
    z = (F.col("toxic") / n1 - F.col("clean") / n0) / F.sqrt(share * (1 - share + 1e-9) * (1 / n1 + 1 / n0))
    common = word_labels(sample).filter(F.length("word") <= 64).withColumn("z", z).filter("z >= 3 and toxic >= 2")
    rows = common.orderBy(F.desc("z"), "word").limit(candidates).collect()
    words, gain = [r["word"] for r in rows], np.array([r["z"] for r in rows])
    if not words:
        return []
    near = Kernel(words).values(words)
    far, taken = np.ones(len(words)), []
    for _ in range(min(landmarks, len(words))):
        best = int((gain * far).argmax())
        if taken and far[best] < 0.02:
            break
        taken.append(best)
        far = np.minimum(far, 1 - near[:, best])
        far[best] = 0
    return [words[i] for i in taken]


def spoiled(text: str, letters: int = 1) -> str:
    """The text with letters inserted in every word of four or more: a neighbour doubled, or another word's.

    One letter stands in one place; of more, each stands in a place of its own.
    """
    out = []
    for word in text.split():
        if len(word) >= 4:
            draw = zlib.crc32(word.encode("utf-8", "surrogatepass"))
            for more in range(letters):
                at = 1 + (draw + 2 * more) % (len(word) - 1)
                word = word[:at] + (word[at - 1] if draw & 65536 and not more else text[(draw + more) % len(text)].strip() or "x") + word[at:]
        out.append(word)
    return " ".join(out)


def fit_machine(features: np.ndarray, labels: np.ndarray, kernel: Kernel, cost: float = 1.0, counts: np.ndarray | None = None) -> Model:
    """Linear machine on Nyström features: squared hinge loss, Newton steps on its active set.

    Features are kernel values k; the map is k @ K^(-1/2) with the landmarks' own matrix K.
    Margins become probabilities by a logistic fit in which a row
    has the weight ``counts`` (1, if not given), so that copies made for training do not count as as many labels.
    """
    own = kernel.values(kernel.landmarks).astype(float)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    value = np.maximum(value, 1e-2)
    whiten = vector / np.sqrt(value) @ vector.T
    x = np.c_[features @ whiten, np.ones(len(features))]
    y = np.where(labels > 0, 1.0, -1.0)
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * cost
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    active = np.ones(len(y), bool)
    for _ in range(50):
        xa = x[active] * weight[active, None]
        w = np.linalg.solve(ridge + xa.T @ x[active], xa.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    margin, target, a, b = x @ w, (y > 0).astype(float), 1.0, 0.0
    each = np.ones(len(y)) if counts is None else counts
    for _ in range(100):  # damped Newton on two parameters
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([(each * (p - target) * margin).sum() + 1e-3 * a, (each * (p - target)).sum()])
        s = each * (p * (1 - p) + 1e-6)
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max())
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return Model(kernel.landmarks, whiten @ w[:-1], float(w[-1]), float(a), float(b))


def train(docs: DataFrame, labels: DataFrame, rows: int = 20_000, landmarks: int = 64) -> Model:
    """Model from about ``rows`` labelled texts (``doc_id``, ``text``; ``doc_id``, ``label`` 0 or 1).

    The sample is one class of the hash of the id, of as many as make that size; rows without text, id or
    label teach nothing. Toxic texts are learned again with one, two and three letters
    inserted in every word. With one label only, every score is that label's share.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.filter("doc_id is not null and label in (0, 1)")
    some = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-known.count() // rows)))) == 0)
    sample = materialize(join_sized(docs.select("doc_id", "text").filter("text is not null"), materialize(some, "tox-labels"), ["doc_id"]), "tox-sample")
    picked = pick_landmarks(sample, landmarks)
    if not picked:
        share = sample.agg(F.avg("label")).first()[0] or 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model([], np.zeros(0), 0.0, 1.0, float(np.log(share / (1 - share))))
    shared = spark.sparkContext.broadcast(picked)

    @F.arrow_udf("array<float>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pool = Pool(Kernel(shared.value))
        for texts in batches:
            found = pool.features(texts)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))

    @F.arrow_udf("string")
    def spoil(texts: pa.Array, letters: pa.Array) -> pa.Array:
        return pa.array([spoiled(t, n) for t, n in zip(texts.to_pylist(), letters.to_pylist())], pa.string())

    again = sample.withColumn("letters", F.lit(0))
    for letters in INSERTED:
        again = again.unionByName(sample.filter("label = 1").withColumns({"text": spoil("text", F.lit(letters)), "letters": F.lit(letters)}))
    table = again.select("doc_id", "label", "letters", F.xxhash64("text").alias("mark"), features("text").alias("f"))
    table = table.orderBy("doc_id", "label", "letters", "mark").select("f", "label", "letters").toArrow()  # sums in one order: reruns agree
    grid = table["f"].combine_chunks().flatten().to_numpy().reshape(-1, len(picked))
    return fit_machine(grid, table["label"].to_numpy(), Kernel(picked), counts=np.where(table["letters"].to_numpy() == 0, 1.0, 1 / len(INSERTED)))


def toxicity(spark, model: Model, text: Column) -> Column:
    """Probability of label 1 for a whole text; null counts as the empty text."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        pool = Pool(Kernel(known.landmarks))
        for texts in batches:
            yield pa.array(known.scores(pool.features(texts)).astype(float))

    return run(text)


def score_documents(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 at ``threshold`` or more).

    A text's features are the highest kernel values of any of its words against each
    landmark word; the kernel compares gapped subsequences, so ``i.d.i.o.t`` or ``idiiot`` is near
    ``idiot``, and finds landmarks inside longer words, as in ``youidiotgo`` or ``ixdxiot``. Three
    letters put into a word of five take it below ``LEAST``: ``ixdxixot`` alone is not found. Null and empty texts get the score of a text without any such word. An
    empty table gives an empty table; columns with one of the added names, in upper or lower case, are replaced.
    """
    (score,) = fresh(docs, "_score")
    kept = without(docs, ("score", "predicted"))
    scored = docs.withColumn(score, toxicity(docs.sparkSession, model, F.col(text)))
    return scored.select(*kept, F.col(score).alias("score"), (F.col(score) >= threshold).cast("int").alias("predicted"))
