"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

Voters: words of a lexicon in four languages, families of such words, patterns of form and of address, and words
and word beginnings that a bounded labelled sample ties to toxic rows. A voter votes "toxic" or abstains. The
given label takes part as one more voter, of good but not perfect repute.

Label model: a two-class latent variable with voters that are independent given the class except for
correlated groups. EM estimates each voter's firing rates in both classes, that is its accuracy and coverage;
correlations are the excess of joint votes over what the model expects, and each voter's evidence is divided
by the number of voters that it correlates with (a word and its beginnings count once). The two estimates
alternate. All rates are drawn alike, by SMOOTHING rows, towards the rate in the whole sample, so that a voter
without votes says nothing about any row; silent voters take no part at all. That no voter at all votes for a row is
one joint event, with a rate in each class: that many voters abstain together is no independent evidence. The posteriors are the soft labels
of a logistic regression over the presence of words, word beginnings, families and patterns, which scores every
whole text.

Bounds: SAMPLE_ROWS labelled rows (smallest hashes of the id) are fitted on, one for each id; VOTERS and FEATURES
limit the model. Everything else runs over all rows.

Defined cases: null and empty texts get the score of a text without any feature; rows without labels are
scored like others; with no labelled rows, or rows of one class only, the lexicon and the patterns alone are the
voters, at a fixed prior; of rows that share a labelled id one is learned from; repeated rows get equal results;
empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

SAMPLE_ROWS = 12_000
#: Texts that a worker looks at at once: a text has about a thousand features.
SLICE_ROWS = 50
VOTERS = 400
FEATURES = 3000
PREFIXES = (3, 4, 5, 6, 7)
#: Bounded cache of the features of words.
CACHE_WORDS = 200_000

#: Voters and features need this much evidence: rows times the divergence of their share of toxic rows from that of all.
EVIDENCE = 7.0
#: Rows that draw a firing rate to its mean, and that speak for the given label.
SMOOTHING, REPUTE = 1.0, 100.0

#: Words of abuse in four languages, by family.
LEXICON = {
    "=insult": (
        "idiot idiots idiotic stupid moron morons moronic imbecile imbeciles dumb dumbass dimwit halfwit fool fools clown clowns loser losers jerk creep freak "
        "coward liar pathetic worthless useless disgusting hideous braindead dummkopf trottel vollidiot idioten blödmann versager feigling lügner dumm hässlich "
        "imbécile crétin crétins abruti abrutis débile bouffon minable lâche menteur idiota idiotas imbécil estúpido estúpida tonto tonta payaso cobarde mentiroso inútil"
    ).split(),
    "=contempt": (
        "scum trash garbage vermin filth filthy maggot maggots pig pigs rat rats parasite parasites subhuman degenerate abschaum ungeziefer gesindel pack drecksack dreckig "
        "ordure ordures vermine déchet racaille parasitos escoria basura alimaña rata cerdo"
    ).split(),
    "=profanity": (
        "shit bullshit crap fuck fucks fucked fucker fucking bastard bastards bitch bitches asshole assholes slut whore retard retarded arschloch arsch scheiße wichser "
        "hurensohn schlampe fotze miststück connard connards connasse salaud salope enculé putain merde gilipollas cabrón cabrones puta putas mierda pendejo coño"
    ).split(),
    "=threat": "kill murder strangle lynch exterminate hang verrecke verrecken krepier umbringen aufhängen crève crever tuer égorger muérete matar ahorcar".split(),
}
FAMILY = {word: family for family, words in LEXICON.items() for word in words}
_ABUSE = "stupid|idiot|moron|pathetic|worthless|disgusting|loser|trash|scum|clown|ugly|useless|garbage|dumb"
PATTERNS = {
    "=shout": re.compile(r"\b[A-Z]{4,}\b(?:\W+[A-Z]{4,}\b){2}"),
    "=marks": re.compile(r"[!?]{3,}"),
    "=reader": re.compile(rf"(?i)\byou(?:'re| are)? (?:an? |all |such an? |so |just an? )?(?:{_ABUSE})"),
    "=your_kind": re.compile(r"(?i)\b(?:your kind|you people|people like you|leute wie du|gente como tú|les gens comme toi)\b"),
    "=what_a": re.compile(rf"(?i)\b(?:what an?|such an?|bunch of|pack of|piece of) (?:\w+ )?(?:{_ABUSE})"),
    "=go_away": re.compile(r"(?i)\b(?:shut up|go to hell|drop dead|get lost|kill yourself|halt die klappe|halt's maul|verpiss dich|ferme[- ]la|ta gueule|cállate|vete al infierno)\b"),
    "=wish": re.compile(r"(?i)\b(?:hope|wish) (?:you|they|he|she) (?:all )?(?:die|rot|suffer|burn)\b"),
    "=will_hurt": re.compile(r"(?i)\b(?:i|we)(?:'ll| will|'m going to| am going to) (?:kill|hurt|find|destroy|beat) (?:you|them|him|her)\b"),
    "=hate": re.compile(r"(?i)\b(?:i|we) (?:really |all )?(?:hate|despise|loathe) (?:you|them|him|her|these)\b"),
    "=stars": re.compile(r"\b\w\*{2,}\w*\b"),
    "=stretched": re.compile(r"(?i)\b(?:stu+pid|idi+ot|lo+ser|mo+ron|fu+ck|shi+t)\b(?<!stupid)(?<!idiot)(?<!loser)(?<!moron)(?<!fuck)(?<!shit)"),
}
WORDS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicityModel:
    bias: float
    weights: dict[str, float]
    #: For inspection: voter, accuracy (how often its vote is right), coverage, correlated voters.
    voters: list[tuple[str, float, float, int]] = field(default_factory=list)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls into the fold that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def word_features(word: str) -> tuple[str, ...]:
    family = (FAMILY[word],) if word in FAMILY else ()
    return (word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n), *family)


def text_features(text: str | None) -> set[str]:
    """Words, word beginnings, families and patterns that occur in a text."""
    text = text or ""
    found = {f for w in set(WORDS.findall(text.lower())) for f in word_features(w)}
    return found | {name for name, p in PATTERNS.items() if p.search(text)}


def label_model(votes: np.ndarray, annotator: int | None, prior: float = 0.1, rounds: int = 40, correlate: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """votes: rows x voters, 1 vote, 0 none; annotator: the column of the given labels. Returns posteriors, firing rates (2 x voters), group sizes."""
    n, m = votes.shape
    mean = np.clip(votes.mean(0), 1e-6, 1 - 1e-6)
    towards = np.vstack([mean, mean])
    strength = np.full(m, SMOOTHING)
    groups = np.ones(m)
    others = np.arange(m) != (-1 if annotator is None else annotator)
    silent = votes[:, others].sum(1) == 0
    if annotator is None:
        agreed = votes.sum(1)
        q = np.clip(prior * agreed / max(float(agreed.mean()), 1e-9), 0.01, 0.95)
    else:
        towards[:, annotator], strength[annotator] = (0.02, 0.95), REPUTE
        q = np.where(votes[:, annotator] > 0, 0.95, 0.02)
    for step in range(rounds):
        weight = np.vstack([1 - q, q])
        rates = (weight @ votes + strength * towards) / (weight.sum(1)[:, None] + strength)
        # A voter may abstain on toxic rows, but may not vote for clean ones more often than for toxic ones.
        rates[0] = np.minimum(rates[0], rates[1])
        if correlate and step % 10 == 5:
            # Correlations: joint votes in the toxic class beyond independence.
            both = (votes * q[:, None]).T @ votes / max(float(q.sum()), 1e-9)
            spread = np.sqrt(rates[1] * (1 - rates[1]))
            excess = (both - np.outer(rates[1], rates[1])) / np.maximum(np.outer(spread, spread), 1e-9)
            np.fill_diagonal(excess, 1.0)
            groups = np.maximum(1.0, np.clip(np.where(excess > 0.3, excess, 0), 0, 1).sum(0))
            if annotator is not None:
                groups[annotator] = 1.0
        p = (q.sum() + 5 * prior) / (n + 5)
        evidence = (votes * np.log(rates[1] / rates[0]) + (1 - votes) * np.log((1 - rates[1]) / (1 - rates[0]))) / groups
        none = (weight @ silent + SMOOTHING * silent.mean()) / (weight.sum(1) + SMOOTHING)
        odds = np.log(p / (1 - p)) + np.where(silent, np.log(none[1] / none[0]), evidence[:, others].sum(1)) + evidence[:, ~others].sum(1)
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return q, rates, groups


def logistic(x: list[np.ndarray], size: int, y: np.ndarray, steps: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, rows as index arrays, by Adam on the full batch."""
    row = np.repeat(np.arange(len(x)), [len(i) for i in x])
    col = np.concatenate(x).astype(int) if x else np.zeros(0, int)
    w, b = np.zeros(size), float(np.log(np.clip(y.mean(), 1e-3, 0.999) / (1 - np.clip(y.mean(), 1e-3, 0.999))))
    m, s = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(row, w[col], len(x))
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(x)
        g = np.append(np.bincount(col, d[row], size) + decay * w, d.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, so that what a worker makes of them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learns from the labelled rows outside the held-out fold."""
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(~held_out(F.col("id")))
    sample = named.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(sample_rows)
    # At most sample_rows narrow rows are broadcast to the scan of the texts.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [sorted(text_features(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.list_(pa.string()))], names=["id", "y", "features"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    extracted = rows.select("id", "text", "y").mapInArrow(extract, f"id {kind}, y int, features array<string>")
    extracted = materialize(extracted.groupBy("id").agg(F.max("y").alias("y"), F.min("features").alias("features")), "toxicfeatures")
    totals = extracted.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).first()
    n, pos = totals["n"], totals["p"] or 0
    if not n or not pos or pos == n:
        return ToxicityModel(-2.2, dict.fromkeys(FAMILY, 4.0) | {"=reader": 3.0, "=go_away": 3.0, "=will_hurt": 3.0})
    counted = extracted.select(F.explode("features").alias("f"), "y").groupBy("f").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("c"))
    share, own = pos / n, F.col("a") / F.col("c")
    part = lambda x, base: F.when(x > 0, x * F.log(x / F.lit(base))).otherwise(F.lit(0.0))
    evidence = F.col("c") * (part(own, share) + part(1 - own, 1 - share)) * F.when(own > share, F.lit(1)).otherwise(F.lit(-1))
    counted = materialize(counted.where("c >= 2").withColumn("e", F.round(evidence, 9)), "toxiccounts")
    named = [*FAMILY, *LEXICON, *PATTERNS]
    seen = {r["f"] for r in counted.where(F.col("f").isin(named)).select("f").collect()}  # at most as many as are named
    mined = counted.where((F.col("e") >= EVIDENCE) & (F.col("a") >= 2)).orderBy(F.desc("e"), "f").limit(VOTERS).select("f").toPandas()["f"].tolist()
    spread = counted.where(F.abs("e") >= EVIDENCE).orderBy(F.desc(F.abs("e")), "f").limit(FEATURES).select("f").toPandas()["f"].tolist()
    voters = list(dict.fromkeys([f for f in named if f in seen] + mined))
    wanted = list(dict.fromkeys(voters + spread))
    index = {f: i for i, f in enumerate(wanted)}

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = [[index[f] for f in fs if f in index] for fs in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.list_(pa.int32()))], names=["y", "at"])

    # Bounded: sample_rows rows of feature numbers.
    bounded = extracted.select("y", "features").mapInArrow(indexed, "y int, at array<int>").collect()
    bounded = sorted(bounded, key=lambda r: (r["at"], r["y"]))
    at = [np.array(r["at"], int) for r in bounded]
    votes = np.zeros((len(at), len(voters) + 1))
    for i, a in enumerate(at):
        votes[i, a[a < len(voters)]] = 1
    votes[:, -1] = [r["y"] for r in bounded]
    q, rates, groups = label_model(votes, len(voters), prior=pos / n)
    w, b = logistic(at, len(wanted), q)
    told = [(f, float(rates[1, i] * q.mean() / max(rates[1, i] * q.mean() + rates[0, i] * (1 - q.mean()), 1e-12)), float(votes[:, i].mean()), int(round(groups[i]))) for i, f in enumerate([*voters, "label"])]
    return ToxicityModel(float(b), {f: float(x) for f, x in zip(wanted, w, strict=True) if abs(x) > 1e-3}, told)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, carry: str | None = None) -> DataFrame:
    """id, score, predicted for every row; with carry, all columns of docs and the score under that name instead."""
    # Texts are sent to the workers once, also where they are carried.
    base = docs if carry else docs.select(F.col(id_col), F.col(text_col).alias("text"))
    at = [c.lower() for c in docs.columns].index(text_col.lower()) if carry else 1
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    if carry:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        schema = f"{fields}, `{carry}` double"
    else:
        schema = f"doc {kind}, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[str, ...]] = {}
        weights = model.weights
        patterns = [(name, p) for name, p in PATTERNS.items() if name in weights]
        for b in slices(batches, 20 * SLICE_ROWS):
            out = np.empty(b.num_rows)
            for i, text in enumerate(b.column(at)):
                text = text.as_py() or ""
                found: set[str] = set()
                for w in set(WORDS.findall(text.lower())):
                    hits = cache.get(w)
                    if hits is None:
                        hits = cache[w] = tuple(f for f in word_features(w) if f in weights)
                    if hits:
                        found.update(hits)
                z = model.bias + sum(weights[f] for f in sorted(found)) + sum(weights[name] for name, p in patterns if p.search(text))
                out[i] = 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))
            if len(cache) > CACHE_WORDS:
                cache.clear()
            columns = b.columns if carry else [b.column(0)]
            names = list(b.schema.names) if carry else ["doc"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out)], names=[*names, carry or "score"])

    scored = base.mapInArrow(score, schema)
    if carry:
        return scored
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("doc", id_col)
