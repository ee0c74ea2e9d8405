"""Subject areas of documents, by class-association rules.

Rules "these phrases, then that subject" are mined from the sentences of labelled documents with parallel frequent-pattern
growth; a rule that says no more than a shorter one is dropped. A sentence deals with a subject if the best of its
matching rules, its confidence drawn towards the subject's share where there is little support, is more likely right than
not; a document has the subjects that enough of its sentences deal with.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.handwritten import listed
from scanloom.plans.lineage import cut
from scanloom.plans.spread import spread

#: Phrases have to occur in this share of the labelled documents (and in LEAST of them); that bounds how many there are.
SUPPORT = 0.004
LEAST = 3
#: Of documents with the phrase, the least share that has its commonest subject, for the phrase to be mined at all.
HINT = 0.25
#: A rule counts from this likelihood on.
SURE = 0.6
#: Rules are weighed against each other on about so many labelled sentences, those of the lowest hash: a rule stays
#: if enough of its places aren't those of better rules already.
COVER = 100_000
_SLACK = 0.02
#: Phrases and rules are held by the driver and by every task; more than this are refused, and SUPPORT must be raised.
MOST_RULES = 1_000_000

_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
_LINES = re.compile(r"[\r\n  ]+")
_LOG = re.compile(r"\s*(?:\[[A-Z]+\]|\d{4}-\d\d-\d\d|at [\w.$]+\()")
_ENDS = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_LETTER = re.compile(r"[^\W\d_]")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_WORDS = re.compile(r"[a-z]+")
_HAN = re.compile(r"[㐀-鿿]+")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text, the lines of a log; blocks of code and what has no letter are none."""
    if not text:
        return []
    out = []
    for line in _LINES.split(_CODE.sub("\n", text)):
        out += [line] if _LOG.match(line) else _ENDS.split(line)
    return [s for s in out if _LETTER.search(s)]


def _words(plain: str) -> list[str]:
    return [w[:-1] if len(w) > 3 and w[-1] == "s" and w[-2] != "s" else w for w in _WORDS.findall(plain)]


def _plain(sentence: str) -> str:
    return _CAMEL.sub(" ", sentence).replace("_", " ").replace("-", " ").lower()


def _tokens(sentence: str) -> str:
    """The words and Han runs of a sentence in order, each between blanks; a phrase stands in it as it is spelt here."""
    out = []
    for m in re.finditer(r"[a-z]+|[㐀-鿿]+", _plain(sentence)):
        out += _words(m[0]) or [m[0]]
    return f" {' '.join(out)} "


def phrases(sentence: str) -> set[str]:
    """Runs of one to three words, however they are joined and spelt, and of two to five Han characters."""
    plain = _plain(sentence)
    w = _words(plain)
    out = {" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)}
    for run in _HAN.findall(plain):
        out.update(run[i : i + k] for k in (2, 3, 4, 5) for i in range(len(run) - k + 1))
    return out


def _spaced(sentence: str) -> str:
    """The words of a sentence, each between blanks, then its Han runs, apart from each other: what stands in it so is what phrases() gives."""
    plain = _plain(sentence)
    return f" {' '.join(_words(plain))} \n" + "\n".join(_HAN.findall(plain))


def _parts(phrase: str) -> set[str]:
    """The phrases that stand within a phrase."""
    if _HAN.match(phrase):
        return {phrase[i : i + k] for k in range(2, len(phrase)) for i in range(len(phrase) - k + 1)}
    w = phrase.split(" ")
    return {" ".join(w[i : i + k]) for k in range(1, len(w)) for i in range(len(w) - k + 1)}


def _telling(rows: list[tuple[str, int, str, float]]) -> set[str]:
    """Of phrases (phrase, documents, subject, confidence), one of those that always come together: not the
    longer if a shorter is as sure and more frequent, not the shorter if a longer is as sure and as frequent."""
    known = {p: (n, s, c) for p, n, s, c in rows}
    drop = set()
    for p, (n, s, c) in known.items():
        for q in _parts(p):
            if q in known and known[q][1] == s:
                m, _, d = known[q]
                if d >= c - _SLACK and m * 0.95 > n:
                    drop.add(p)
                elif c >= d - _SLACK and n >= m * 0.95:
                    drop.add(q)
    return set(known) - drop


@dataclass
class Rules:
    """single: phrase -> {subject: likelihood}; several: (phrases, subject, likelihood)."""

    single: dict[str, dict[str, float]] = field(default_factory=dict)
    several: list[tuple[frozenset, str, float]] = field(default_factory=list)

    def __getstate__(self):
        return self.single, self.several

    def __setstate__(self, state):
        self.single, self.several = state
        self._found = None

    _found = None

    def _matcher(self):
        """All phrases of the rules as one automaton over sentences as _spaced gives them."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for p in {*self.single, *(x for need, _, _ in self.several for x in need)}:
            found.add_word(p if _HAN.match(p) else f" {p} ", p)
        if len(found):
            found.make_automaton()
        return found

    def evidence(self, sentence: str) -> dict[str, float]:
        """The likelihood of each subject that a matching rule speaks for."""
        if self._found is None:
            self._found = self._matcher()
        out: dict[str, float] = {}
        if not len(self._found):
            return out
        found = {p for _, p in self._found.iter(_spaced(sentence))}
        for p in found & self.single.keys():
            for s, like in self.single[p].items():
                out[s] = max(out.get(s, 0.0), like)
        if self.several and len(found) > 1:
            for need, s, like in self.several:
                if need <= found:
                    out[s] = max(out.get(s, 0.0), like)
        return out

    def subjects(self, text: str | None, share: float = 0.25, sure: float = SURE) -> list[str]:
        """The subjects that at least `share` of the text's sentences deal with."""
        all_of = sentences(text)
        n = Counter(s for x in all_of for s, like in self.evidence(x).items() if like >= sure)
        return sorted(s for s, k in n.items() if k >= share * len(all_of))


def _labelled(docs: DataFrame, labels: DataFrame, areas: set[str]) -> DataFrame:
    """(text, subjects) of each labelled document: the subjects that at least half of its reviewers gave."""
    votes = labels.select("id", F.trim("subject").alias("subject"), F.coalesce("reviewer", F.lit("")).alias("reviewer")).dropna(subset=["id"]).distinct()
    n = votes.groupBy("id").agg(F.countDistinct("reviewer").alias("reviewers"))
    given = votes.filter(F.col("subject").isin(sorted(areas))).groupBy("id", "subject").agg(F.countDistinct("reviewer").alias("votes"))
    kept = n.join(given, "id", "left").groupBy("id").agg(F.collect_set(F.when(2 * F.col("votes") >= F.col("reviewers"), F.col("subject"))).alias("subjects"))
    return docs.select("id", "text").filter(F.length("text") > 0).join(kept, "id").select("text", "subjects")


def mine_rules(docs: DataFrame, labels: DataFrame, areas: set[str]) -> Rules:
    """Rules from documents (id, text) and labels (id, subject, reviewer)."""
    from pyspark.ml.fpm import FPGrowth

    base = cut(spread(_labelled(docs, labels, areas)))
    n_docs = base.count()
    if not n_docs:
        return Rules()
    least = max(LEAST, -(-n_docs * SUPPORT // 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for text, subjects in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for p in set().union(*map(phrases, sentences(text))) if text else ():
                    n[p, ""] += 1
                    for s in subjects:
                        n[p, s] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["phrase", "subject", "n"])

    counted = base.mapInArrow(count, "phrase string, subject string, n bigint").groupBy("phrase", "subject").agg(F.sum("n").alias("n"))
    each = counted.groupBy("phrase").agg(F.max(F.when(F.col("subject") == "", F.col("n"))).alias("n"), F.max(F.when(F.col("subject") != "", F.struct("n", "subject"))).alias("top"))
    hints = each.filter((F.col("n") >= least) & (F.col("top.n") >= HINT * F.col("n"))).limit(MOST_RULES + 1).collect()
    if len(hints) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} phrases")
    telling = _telling([(r["phrase"], r["n"], r["top"]["subject"], r["top"]["n"] / r["n"]) for r in hints])

    def baskets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, plain = [], []
            for text, subjects in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                classes = [f"={s}" for s in subjects]
                for x in sentences(text):
                    if found := phrases(x) & telling:
                        out.append([*found, *classes])
                        plain.append(_tokens(x))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), pa.array(plain, pa.string())], names=["items", "plain"])

    basket = cut(base.mapInArrow(baskets, "items array<string>, plain string"))
    n_baskets = basket.count()
    if not n_baskets:
        return Rules()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n_baskets), minConfidence=HINT, numPartitions=max(2, basket.rdd.getNumPartitions())).fit(basket)
    rules = model.associationRules.filter(F.element_at("consequent", 1).startswith("=") & ~F.exists("antecedent", lambda x: x.startswith("=")))
    both = F.col("support") * n_baskets
    # The likelihood below is no more than this, and a rule that doesn't reach SURE is of no use.
    rules = rules.filter((both + 2) / (both / F.col("confidence") + 2) >= SURE).select("antecedent", F.expr("substring(consequent[0], 2)").alias("subject"), "confidence", "support")
    rows = rules.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    share = Counter()
    for r in basket.select(F.explode(F.filter("items", lambda x: x.startswith("="))).alias("c")).groupBy("c").count().collect():
        share[r["c"][1:]] = r["count"] / n_baskets
    found: dict[tuple[frozenset, str], tuple[float, float]] = {}
    for r in sorted(rows, key=lambda r: (len(r["antecedent"]), sorted(r["antecedent"]), r["subject"])):
        both = r["support"] * n_baskets
        like = (both + 2 * share[r["subject"]]) / (both / r["confidence"] + 2)
        need = frozenset(r["antecedent"])
        shorter = (found.get((frozenset(part), r["subject"])) for k in range(1, len(need)) for part in combinations(need, k))
        if like >= SURE and not any(known and known[0] >= like - _SLACK for known in shorter):
            found[need, r["subject"]] = like, both
    whole = 1 << 30
    part = min(whole, int(whole * COVER / n_baskets) + 1)
    sample = basket.filter(F.pmod(F.xxhash64("items"), F.lit(whole)) < part).collect()
    at: dict[str, set[int]] = {}
    for i, r in enumerate(sample):
        for x in r["items"]:
            at.setdefault(x, set()).add(i)
    spans: dict[int, list[tuple[int, int]]] = {}
    out = Rules()
    for (need, s), (like, both) in sorted(found.items(), key=lambda f: (-round(f[1][0], 1), -f[1][1], sorted(f[0][0]), f[0][1])):
        right = set.intersection(*(at.get(x, set()) for x in [*need, f"={s}"]))
        new: dict[int, list[tuple[int, int]]] = {}
        for i in right:
            if len(need) > 1:
                if not spans.get(i):
                    new[i] = [(0, 0)]
                continue
            phrase = next(iter(need))
            edge = "" if _HAN.match(phrase) else " "
            k = sample[i]["plain"].find(edge + phrase + edge)
            while k >= 0:
                low, high = k + len(edge), k + len(edge) + len(phrase)
                if not any(a < high and low < b for a, b in spans.get(i, ())):
                    new.setdefault(i, []).append((low, high))
                k = sample[i]["plain"].find(edge + phrase + edge, k + 1)
        if len(new) < max(2, 0.15 * len(right)):
            continue
        for i, found_at in new.items():
            spans.setdefault(i, []).extend(found_at)
        if len(need) == 1:
            phrase = next(iter(need))
            for spelt in {phrase, phrase.replace(" ", "")} if len(phrase) >= 8 else {phrase}:
                out.single.setdefault(spelt, {})[s] = like
        else:
            out.several.append((need, s, like))
    return out


def subject_areas(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    labels: DataFrame,
    areas: DataFrame,
    share: float = 0.25,
) -> DataFrame:
    """(id_col, subject): the subjects of areas(subject) that at least `share` of a document's sentences deal with.

    labels: (id_col, subject, reviewer) of some of the documents, subjects not in areas meaning none. Every document is
    judged by its text, labelled ones too. A null, empty or blank text has no subject; no labels, no subjects.
    areas is a list of no more than MOST_NAMES, held by every task; so are the rules, no more than MOST_RULES; longer ones are refused. Ids given twice have each of
    their subjects once. Extra columns are not read.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    given = labels.select(F.col(f"`{id_col}`").alias("id"), "subject", "reviewer")
    allowed = set(listed(areas.select(F.trim("subject").alias("subject"))))
    rules = mine_rules(texts, given, allowed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for s in rules.subjects(text, share):
                    rows.append(i)
                    found.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=["id", "subject"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(texts.filter(F.length("text") > 0)).mapInArrow(run, f"id {kind}, subject string").dropDuplicates().withColumnRenamed("id", id_col)
