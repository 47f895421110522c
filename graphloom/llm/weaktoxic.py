"""Toxicity by weak supervision: many weak voters, a label model of their accuracies and correlations, a linear classifier.

Voters are word lists, patterns of address, disguise and threat, lists of words and word stems mined from labelled texts,
and signs of harmless text. Each votes for one class or abstains, so the votes on a text are a set of bits, and the votes
on the whole corpus are a count for each set that occurs (at most 2**20, however large the corpus). The label model is a tree-augmented
latent class model: each voter depends on the hidden class and on the one other voter it is most correlated with inside
the classes. It is fitted by expectation maximisation on the counts of all documents, where labels are one more voter. Its posterior is
the target of a logistic regression on votes, words and stems, which also reads texts on which no voter has an opinion. A curve fitted on
labelled texts outside the held-out fold turns the regression's figure into a probability of the label.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fold_of, in_arrow, written
from graphloom.llm.termsearch import FOLD

#: Insults and abuse by kind, in English, German, French and Spanish.
LEXICONS = {
    "wits": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile dimwit halfwit idioten dumm dummkopf blöd trottel depp schwachkopf idiote imbécile stupide crétin débile abruti idiota estúpido estúpida imbécil tonto",
    "worth": "worthless loser losers pathetic versager wertlos erbärmlich minable raté inútil perdedor patético",
    "vermin": "scum vermin trash garbage filth parasite subhuman abschaum ungeziefer dreck ordure vermine racaille escoria basura",
    "disgust": "disgusting vile repulsive sickening revolting ekelhaft widerlich dégoûtant répugnant asqueroso repugnante",
    "mockery": "clown clowns freak creep weirdo crybaby spinner bouffon payaso",
    "profanity": "crap shit fuck fucking bitch bastard asshole scheisse scheiße arschloch merde putain connard mierda puta cabrón gilipollas",
}
_ADDRESS = {w for w in "you your yours youre ur u du dich dir dein ihr tu te toi ton vous votre eres tú usted vosotros".split()}
_THREATS = {w for w in "kill hurt hate destroy smash beat töte hasse tuer hais matar odio".split()}
_TARGETS = {w for w in "you yourself them him her dich euch te toi vous".split()}
_DISMISS = {tuple(p.split()) for p in ("shut up", "get lost", "drop dead", "ta gueule", "halts maul", "cierra boca")}
#: The mined lists: words in two halves, stems, and families (stems of which two different words are the evidence) by how
#: many of their words a text has.
MINED = ("word0", "word1", "stem", "family1", "family2", "family3")
VOTERS = (*LEXICONS, *MINED, "address", "disguise", "shout", "several", "threat", "dismissal", "calm", "quiet")
#: The last two vote for clean, all others for toxic.
FOR_CLEAN = 2
_LEET = str.maketrans("@$!013457", "asioieast")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_LETTERS = (3, 8)  # of a stem
_PUNCTUATION = re.compile("[¡«»¿‐-‧、。]")


@dataclass(frozen=True)
class Settings:
    """Bounds of what is fitted on a sample, and the strength of its terms.

    texts: labelled texts of each label at most, those with the smallest hash of their id. mined: words and stems of each
    kind at most, whose share of toxic texts is at least `purity`, taken `sure` standard errors low. features: terms of the
    classifier at most, each at least `evidence` standard errors from no effect.
    """

    texts: int = 4000
    mined: int = 60
    purity: float = 0.4
    sure: float = 3.0
    features: int = 512
    evidence: float = 4.0
    ridge: float = 0.3


@dataclass(frozen=True)
class Lists:
    """Word lists of the voters, fixed ones first; features of each mined list; all words; disguised forms of fixed ones."""

    lists: tuple[frozenset, ...]
    mined: tuple[frozenset, ...]
    known: frozenset
    disguised: frozenset

    def reader(self, *more: str) -> Reader:
        """Finds the mined features, and more."""
        return Reader([*(f for own in self.mined for f in own), *more])


@dataclass(frozen=True)
class LabelModel:
    """prior of toxic; parent of each voter (-1: none); chance[y][j][p]: that voter j votes, in class y, where its parent
    votes (p 1) or not (p 0)."""

    prior: float
    parent: tuple[int, ...]
    chance: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of toxic for rows of votes (0 or 1)."""
        log = np.log([1 - self.prior, self.prior])[None, :] + np.zeros((len(votes), 1))
        for j, p in enumerate(self.parent):
            given = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
            for y in (0, 1):
                c = self.chance[y, j, given]
                log[:, y] += np.where(votes[:, j] == 1, np.log(c), np.log(1 - c))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))


@dataclass(frozen=True)
class Model:
    """weights of features and votes, the constant, and the curve (slope, offset) of the classifier's figure; the lists and
    the label model that it was made from."""

    weights: dict
    constant: float
    curve: tuple[float, float]
    lists: Lists
    label_model: LabelModel
    votes: np.ndarray


def lists_of(mined: dict[str, list[str]]) -> Lists:
    """The fixed lists, and the lists of mined features."""
    fixed = tuple(frozenset(words.split()) for words in LEXICONS.values())
    words, families = mined.get("word", []), [f.rstrip("+") for f in mined.get("family", [])]
    dealt = (words[::2], words[1::2], mined.get("stem", []), *([f + "+" * n for f in families] for n in (1, 2, 3)))
    every = frozenset().union(*fixed)
    disguised = {w[:i] + "*" + w[i + 1 :] for w in every if len(w) > 3 for i in range(1, len(w) - 1)} | {w[:1] + "*" * (len(w) - 2) + w[-1:] for w in every if len(w) > 3}
    return Lists(fixed, tuple(map(frozenset, dealt)), every.union(words), frozenset(disguised))


def words_of(text: str | None) -> list[str]:
    """A text's words; a null text is empty. Only A-Z are lower-cased; white space and marks beyond ASCII part words, too."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(FOLD).decode().split()
    return _PUNCTUATION.sub(" ", text).encode("utf-8", "surrogatepass").translate(FOLD).decode("utf-8", "surrogatepass").split()


def features_of(distinct: set[str]) -> set[str]:
    """A text's features: its words, `stem+` for each beginning of 3 to 8 letters of a longer word, and `stem++`
    (`stem+++`) for each beginning of two (three) different longer words."""
    low, high = _LETTERS
    longer = Counter(w[:n] for w in distinct for n in range(low, min(len(w) - 1, high) + 1))
    return distinct | {p + "+" * k for p, n in longer.items() for k in range(1, min(n, 3) + 1)}


class Reader:
    """Finds wanted features only: words by sets, stems under their first letters."""

    def __init__(self, wanted: Iterable[str]):
        self.wanted = frozenset(wanted)
        self.starts: dict[str, list[str]] = {}
        for p in {f.rstrip("+") for f in self.wanted if f.endswith("+")}:
            self.starts.setdefault(p[: _LETTERS[0]], []).append(p)

    def found(self, distinct: set[str]) -> set[str]:
        longer: dict[str, int] = {}
        for w in distinct:
            for p in self.starts.get(w[: _LETTERS[0]], ()):
                if len(w) > len(p) and w.startswith(p):
                    longer[p] = longer.get(p, 0) + 1
        return (distinct & self.wanted) | (self.wanted & {p + "+" * k for p, n in longer.items() for k in range(1, min(n, 3) + 1)})


def _disguised(text: str, lists: Lists) -> bool:
    """Whether a word stands there with stars, signs or digits for letters."""
    if not any(c in text for c in "*@$013457"):
        return False
    for w in text.lower().split():
        w = w.strip(".,;:!?\"'()")
        if not w.isalpha() and 3 < len(w) < 40 and (w in lists.disguised or w.translate(_LEET) in lists.known and w not in lists.known):
            return True
    return False


def votes_of(text: str | None, lists: Lists) -> int:
    """The voters that vote on a text, as bits in the order of VOTERS."""
    words = words_of(text)
    distinct = set(words)
    return votes_on(text or "", words, distinct, lists.reader().found(distinct), lists)


def votes_on(text: str, words: list[str], distinct: set[str], found: set[str], lists: Lists) -> int:
    """votes_of a text whose words and mined features are at hand."""
    hits = distinct & lists.known
    votes = [not hits.isdisjoint(own) for own in lists.lists]
    votes += [not found.isdisjoint(own) for own in lists.mined]
    address = bool(hits) and not distinct.isdisjoint(_ADDRESS) and any(w in hits and not _ADDRESS.isdisjoint(words[max(i - 4, 0) : i + 4]) for i, w in enumerate(words))
    shout = any(re.search(r"\b" + re.escape(h.upper()) + r"\b", text) for h in hits)
    pairs = lambda first: ((a, b) for a, b in zip(words, words[1:]) if a in first)
    threat = not distinct.isdisjoint(_THREATS) and any(b in _TARGETS for _, b in pairs(_THREATS))
    dismissal = any(set(p) <= distinct for p in _DISMISS) and any(p in _DISMISS for p in pairs({a for a, _ in _DISMISS}))
    votes += [address, _disguised(text, lists), shout, len(hits) > 1, threat, dismissal]
    raw = text.encode("utf-8", "surrogatepass")
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    votes += [len(words) > 4 and "!" not in text and distinct.isdisjoint(_ADDRESS), len(words) > 29 and 20 * capitals < len(text)]
    return sum(1 << i for i, v in enumerate(votes) if v)


def _bits(patterns: Iterable[int]) -> np.ndarray:
    return np.array([[p >> j & 1 for j in range(len(VOTERS))] for p in patterns], dtype=int).reshape(-1, len(VOTERS))


def correlated(votes: np.ndarray, n: np.ndarray, q: np.ndarray, least: float = 20.0) -> tuple[int, ...]:
    """The parent of each voter: a maximum spanning forest over mutual information inside the classes.

    q is the probability of toxic for each row of votes, n its count. A pair is linked where twice the information
    of all rows exceeds `least` (a chi-squared value of one part in 20,000 by chance).
    """
    size = votes.shape[1]
    info = np.zeros((size, size))
    for weight in (n * q, n * (1 - q)):
        total = weight.sum()
        if total <= 0:
            continue
        one = weight @ votes
        both = (votes * weight[:, None]).T @ votes
        for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):
            left, right = (one if a else total - one)[:, None], (one if b else total - one)[None, :]
            joint = both if a and b else (one[:, None] - both if a else (one[None, :] - both if b else total - one[:, None] - one[None, :] + both))
            joint = np.maximum(joint, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                info += np.where(joint > 1e-9, joint * np.log(joint * total / (left * right)), 0)
    parent, inside = [-1] * size, {0}
    best = {j: (info[j, 0], 0) for j in range(1, size)}
    while best:
        j = max(best, key=lambda x: (best[x][0], -x))
        value, p = best.pop(j)
        if 2 * value > least:
            parent[j] = p
        inside.add(j)
        for k in best:
            best[k] = max(best[k], (info[k, j], j), key=lambda x: (x[0], -x[1]))
    return tuple(parent)


def _expected(votes: np.ndarray, n: np.ndarray, q: np.ndarray, parent: tuple[int, ...]) -> LabelModel:
    """The model that fits posteriors q best. A voter that speaks for the other class than its own counts as mute."""
    size = votes.shape[1]
    chance = np.zeros((2, size, 2))
    weight = (n * (1 - q), n * q)
    for j, p in enumerate(parent):
        given = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
        for v in (0, 1):
            at = given == v
            said, all_ = np.array([[w[at] @ votes[at, j] for w in weight], [w[at].sum() for w in weight]])
            pooled = (said.sum() + 0.5) / (all_.sum() + 1)
            rate = (said + 2 * pooled) / (all_ + 2)
            mute = rate[1] > rate[0] if j >= size - FOR_CLEAN else rate[1] < rate[0]
            chance[:, j, v] = np.clip(pooled if mute else rate, 1e-6, 1 - 1e-6)
    return LabelModel(float(np.clip(weight[1].sum() / max(n.sum(), 1e-9), 1e-4, 0.5)), parent, chance)


def label_model(patterns: dict[int, float], marked: dict[tuple[int, bool], float], rounds: int = 60) -> LabelModel:
    """Fits the model to counts by pattern of votes and, of the labelled sample, to counts by (pattern, label).

    A label is one more noisy voter, of whom only the sample tells; the sample weighs as much as all documents, at any
    size of the corpus. Posteriors start from the labels, or without any from the votes for toxic. Accuracies come first,
    voters taken as independent, then their correlations, then both again.
    """
    votes = _bits([*patterns, *(p for p, _ in marked)])
    lift = sum(patterns.values()) / max(sum(marked.values()), 1e-9)
    n = np.array([*patterns.values(), *(w * lift for w in marked.values())], dtype=float)
    said = np.array([*(-1 for _ in patterns), *(int(t) for _, t in marked)], dtype=int)
    seen = said >= 0
    if not len(n):
        return _expected(votes, n, np.zeros(0), (-1,) * len(VOTERS))
    q = np.where(seen, said, 0.0) if seen.any() else np.where(votes[:, :-FOR_CLEAN].any(axis=1), 0.7, 0.02)
    own = n * seen if seen.any() else n
    parent = (-1,) * len(VOTERS)
    model = _expected(votes, own, q, parent)
    word = np.array([0.02, 0.9])  # chance of the label toxic, by class
    for correlations in (False, True):
        if correlations:
            parent = correlated(votes, n, q)
            model = _expected(votes, n, q, parent)
        for _ in range(rounds):
            odds = np.log(np.clip(new := model.posterior(votes), 1e-300, 1)) - np.log(np.clip(1 - new, 1e-300, 1))
            odds = odds + np.where(said == 1, np.log(word[1] / word[0]), np.where(said == 0, np.log((1 - word[1]) / (1 - word[0])), 0.0))
            new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            moved = np.abs(new - q).max()
            q = new
            model = _expected(votes, n, q, parent)
            if seen.any():
                word = np.array([np.clip(((w * (said == 1)).sum() + 1) / ((w * seen).sum() + 2), 1e-3, 1 - 1e-3) for w in (n * (1 - q), n * q)])
            if moved < 1e-7:
                break
    return model


def fitted(present: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression on presence of features (a row for each text) by Newton's method: weights and the constant, which
    the ridge spares. target may be any probability."""
    t = np.column_stack([present, np.ones(len(present))])
    w, hold = np.zeros(t.shape[1]), np.append(np.full(present.shape[1], ridge), 1e-3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(t @ w, -30, 30)))
        slope = t.T @ (weight * (target - p)) - hold * w
        move = np.linalg.solve((t * (weight * p * (1 - p))[:, None]).T @ t + np.diag(hold), slope)
        w = w + np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def curve(logit: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of the logistic curve from the classifier's figure to the label, by Newton's method with halved
    steps; the slope is held near one and is not negative."""
    t = np.column_stack([logit, np.ones(len(logit))])
    w, hold, at = np.array([1.0, 0.0]), np.array([0.1, 1e-3]), np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        x = t @ w
        return float(weight @ (np.logaddexp(0, x) - label * x) + hold @ (w - at) ** 2 / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(t @ w, -500, 500)))
        slope = t.T @ (weight * (label - p)) - hold * (w - at)
        move = np.linalg.solve((t * (weight * p * (1 - p))[:, None]).T @ t + np.diag(hold), slope)
        while np.abs(move).max() > 1e-9 and loss(w + move) > loss(w):
            move = move / 2
        w = w + move
        if np.abs(move).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def _likeness(words: list[str]) -> int:
    """The smallest hash of three words in a row: near copies nearly always share it."""
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) >> 1 for i in range(max(len(words) - 2, 1))), default=0)


def _sample(docs: DataFrame, labels: DataFrame, settings: Settings, folds: int, held_out: int) -> tuple[DataFrame, dict]:
    """(doc_id, text, toxic) of the sampled labelled texts, one of each kind of copies, written; and the number of labels
    of each side."""
    marked = (
        labels.where("doc_id is not null and toxic is not null")
        .where(fold_of(F.col("doc_id"), folds) != held_out)
        .groupBy("doc_id")
        .agg(F.avg(F.col("toxic").cast("double")).alias("mean"))
        .where("mean <> 0.5")
        .select("doc_id", (F.col("mean") > 0.5).alias("toxic"), F.xxhash64(F.lit(29), "doc_id").alias("h"))
    )
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    yes, no = (marked.where(F.col("toxic") == t).orderBy("h", "doc_id").limit(settings.texts).select("doc_id", "toxic") for t in (True, False))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(yes.unionByName(no)), "doc_id")

    def run(batches):
        for batch in batches:
            yield {"doc_id": batch.column(0), "text": batch.column(1), "toxic": batch.column(2), "like": [_likeness(words_of(t)) for t in batch.column(1).to_pylist()]}

    kept = in_arrow(texts, run, "doc_id long, text string, toxic boolean, like long").groupBy("toxic", "like").agg(F.min(F.struct("doc_id", "text")).alias("x"))
    return written(kept.select("x.doc_id", "x.text", "toxic")), counts


def _counted(sample: DataFrame) -> DataFrame:
    """(feature, a, b): in how many toxic and clean texts of the sample each feature is; written."""

    def run(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if t else clean).update(features_of(set(words_of(text))))
        for side, found in enumerate((toxic, clean)):
            n = list(found.values())
            yield {"feature": pa.array(list(found), pa.string()), "a": [0] * len(n) if side else n, "b": n if side else [0] * len(n)}

    found = in_arrow(sample.select("text", "toxic"), run, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return written(found.where("a + b > 2"))


def _mined(counted: DataFrame, lift: dict, settings: Settings) -> dict[str, list[str]]:
    """Features that are surely found in toxic texts more often than in clean ones, at the labels' own shares, by kind."""
    kind = F.when(F.col("feature").endswith("+++"), "").when(F.col("feature").endswith("++"), "family").when(F.col("feature").endswith("+"), "stem").otherwise("word")
    a, b, z2 = F.col("a") * lift[True], F.col("b") * lift[False], settings.sure**2
    share, n = a / (a + b), F.col("a") + F.col("b")
    low = (share + z2 / (2 * n) - settings.sure * F.sqrt((share * (1 - share) + z2 / (4 * n)) / n)) / (1 + z2 / n)
    best = counted.where("a > 0").select("feature", kind.alias("kind"), "a", F.round(low, 9).alias("low")).where(F.col("low") >= settings.purity)
    found = {k: {r["feature"]: r["a"] for r in best.where(F.col("kind") == k).orderBy(F.desc("low"), "feature").limit(settings.mined).collect()} for k in ("word", "stem", "family")}
    # a stem says no more than a word, or a longer stem, that has nearly all of its texts; and of a family of words, which
    # share a stem, two together are the evidence, not each member
    said = lambda f, n, of: any(g != f and g.startswith(f.rstrip("+")) and m >= 0.9 * n for g, m in of.items())
    kept = {k: {f: n for f, n in own.items() if k == "word" or not (said(f, n, found["word"]) or said(f, n, own))} for k, own in found.items()}
    member = lambda f, n: any(f.startswith(g.rstrip("+")) and m >= n for g, m in kept["family"].items())
    return {k: [f for f, n in own.items() if k == "family" or not member(f, n)] for k, own in kept.items()}


def _vocabulary(counted: DataFrame, lift: dict, sizes: dict, settings: Settings) -> list[str]:
    """The features whose presence goes with toxic or clean texts most surely, by standard errors from no effect."""
    share = {t: (F.col(c) + 0.5) / (sizes.get(t, 0) + 1) for t, c in ((True, "a"), (False, "b"))}
    noise = F.sqrt(sum(s * (1 - s) / (sizes.get(t, 0) + 1) for t, s in share.items()))
    z = F.round(F.abs(share[True] - share[False]) / noise, 9)
    return [r["feature"] for r in counted.withColumn("z", z).where(F.col("z") >= settings.evidence).orderBy(F.desc("z"), "feature").limit(settings.features).collect()]


def _patterns(docs: DataFrame, lists: Lists) -> dict[int, int]:
    """How many documents have each pattern of votes; at most 2**20 patterns."""

    def run(batches):
        found = Counter()
        reader = lists.reader()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                distinct = set(words)
                found[votes_on(text or "", words, distinct, reader.found(distinct), lists)] += 1
        yield {"pattern": list(found), "n": list(found.values())}

    rows = in_arrow(docs.select("text"), run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    return {r["pattern"]: r["n"] for r in rows}


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), folds: int = 4, held_out: int = 2) -> Model:
    """Learns the label model from the votes on all documents, and features and the curve from labelled ones outside the
    held-out fold.

    Labels serve to draw the bounded sample, to mine lists and choose features, and for the last curve; the classifier's
    weights follow the label model's posteriors. A label is the mean over its id's rows; ids with a mean of a half, null
    ids and null labels are left out. Without usable labels every text scores a half.
    """
    sample, counts = _sample(docs, labels, settings, folds, held_out)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    lift = {t: counts.get(t, 0) / max(sizes.get(t, 0), 1) for t in (True, False)}
    counted = _counted(sample)
    lists = lists_of(_mined(counted, lift, settings))

    def mark(batches):
        for batch in batches:
            yield {"pattern": [votes_of(t, lists) for t in batch.column(0).to_pylist()], "toxic": batch.column(1)}

    marked = in_arrow(sample.select("text", "toxic"), mark, "pattern long, toxic boolean").groupBy("pattern", "toxic").agg(F.count("*").alias("n")).orderBy("pattern", "toxic").collect()
    model = label_model(_patterns(docs, lists), {(r["pattern"], r["toxic"]): r["n"] * lift[r["toxic"]] for r in marked})
    if not sizes:
        return Model({}, 0.0, (1.0, 0.0), lists, model, np.zeros(len(VOTERS)))
    names = sorted({*_vocabulary(counted, lift, sizes, settings), *(f for own in lists.mined for f in own)})
    place = {f: i + len(VOTERS) for i, f in enumerate(names)}

    def judge(batches):
        reader = Reader(place)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            votes = _bits([votes_of(t, lists) for t in texts])
            found = [sorted(place[f] for f in reader.found(set(words_of(t)))) + np.flatnonzero(v).tolist() for t, v in zip(texts, votes, strict=True)]
            yield {"doc_id": batch.column(0), "toxic": batch.column(2), "q": model.posterior(votes), "features": found}

    rows = in_arrow(sample, judge, "doc_id long, toxic boolean, q double, features array<int>").orderBy("doc_id", "toxic").collect()  # a bounded sample
    present = np.zeros((len(rows), len(place) + len(VOTERS)))
    for i, r in enumerate(rows):
        present[i, r["features"]] = 1
    q, label = (np.array([r[c] for r in rows], dtype=float) for c in ("q", "toxic"))
    weight = np.array([lift[r["toxic"]] for r in rows]) * len(rows) / sum(counts.values())
    weights, constant = fitted(present, q, weight, settings.ridge)
    return Model({f: float(weights[i]) for f, i in place.items()}, constant, curve(present @ weights + constant, label, weight), lists, model, weights[: len(VOTERS)])


def scores(texts: Iterable[str | None], model: Model) -> np.ndarray:
    reader, logit, votes = model.lists.reader(*model.weights), [], []
    for text in texts:
        words = words_of(text)
        distinct = set(words)
        found = reader.found(distinct)
        logit.append(model.constant + sum(model.weights.get(f, 0.0) for f in sorted(found)))
        votes.append(votes_on(text or "", words, distinct, found, model.lists))
    x = np.array(logit, dtype=float) + _bits(votes) @ model.votes
    return 1 / (1 + np.exp(-np.clip(model.curve[0] * x + model.curve[1], -30, 30)))


def scored(docs: DataFrame, model: Model, folds: int = 4, held_out: int = 2, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs(doc_id, text).

    A null text counts as empty and scores as a text without known features. Repeated rows score alike; a null doc_id stays
    null, in fold 0. Texts may be of any length, other columns are ignored, an empty table gives an empty one.
    """

    def run(batches):
        for batch in batches:
            p = scores(batch.column(1).to_pylist(), model)
            yield {"doc_id": batch.column(0), "held_out": batch.column(2), "score": p, "predicted": (p >= least).astype(np.int32)}

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold_of(F.col("doc_id"), folds) == held_out).alias("__out"))
    return in_arrow(given, run, "doc_id long, held_out boolean, score double, predicted int")
