"""Secrets in text: long mixed strings are candidates, a random forest takes out the false ones.

The forest looks at a candidate's length, its character transitions, how much of it dictionary words
cover, whether it stands in a path or address, and the words next to it. Words are counted over all
documents. The forest is trained by Spark on labelled findings from a bounded sample of documents
and applied where the documents are, so no text moves. The labels come from formats that leave no doubt; candidates of no such format are
not trained on, but judged like all others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querykiln.llm.common import arrow_columns, plain_names, stored, table, thinned

SAMPLE_DOCS = 10_000     # documents, about so many picked evenly by hash, that give labelled findings
# A dictionary word is in so many documents, and in such a share of all documents or of those of one
# language. A share keeps chance strings of a large corpus out and bounds the dictionary: at most
# the distinct words of an average document of a language, divided by the share.
DICTIONARY_DOCS = 3
DICTIONARY_SHARE = 3e-4
TREES, DEPTH = 20, 6
SECRET_SCORE = 0.5
MASK = "[SECRET]"

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}={0,2}")
# A provider's key format, and names that values are assigned to.
KEY_FORMAT = re.compile(r"AKIA[0-9A-Z]{16}")
HINTS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "credential")
ASSIGNED = re.compile(r"(?i)([a-z_-]+)\s*[=:]\s*[\"']?$")
_RUN = re.compile(r"[A-Za-z]+")

FEATURES = ("length", "transitions", "bigrams", "entropy", "digits", "capitals", "dictionary", "path", "address",
            "assigned", "hint", "closed")


@dataclass
class Lexicon:
    words: set[str] = field(default_factory=set)
    bigrams: dict[str, float] = field(default_factory=dict)

    def coverage(self, token: str) -> float:
        """Share of characters in dictionary words, longest words first."""
        low, covered, at = token.lower(), 0, 0
        while at < len(low):
            size = next((n for n in range(min(12, len(low) - at), 2, -1) if low[at:at + n] in self.words), 0)
            covered, at = covered + size, at + max(size, 1)
        return covered / len(low)


def candidates(text: str | None):
    """Spans of long ASCII strings with a digit or at least two capitals."""
    for m in CANDIDATE.finditer(text or ""):
        token = m.group()
        if any(c.isdigit() for c in token) or sum(c.isupper() for c in token) > 1:
            yield m.start(), m.end()


def features(text: str, start: int, end: int, lexicon: Lexicon) -> list[float]:
    token, before, after = text[start:end], text[max(0, start - 40):start], text[end:end + 8]
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in token]
    n = len(token)
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / (n - 1)
    letters = [p for run in _RUN.findall(token.lower()) for p in (run[i:i + 2] for i in range(len(run) - 1))]
    common = sum(math.log(lexicon.bigrams.get(p, 1e-6)) for p in letters) / len(letters) if letters else math.log(1e-6)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(token).values())
    assigned = ASSIGNED.search(before)
    left = before.lower().split()[-3:]
    return [float(n), changes, common, entropy, kinds.count(0) / n, kinds.count(2) / n, lexicon.coverage(token),
            float(token.count("/") + before.endswith((".", "\\", "~")) + after.startswith((".", "/"))),
            float("://" in before.rpartition(" ")[2] or before.endswith("@") or after.startswith("@")),
            float(bool(assigned)), float(any(h in w for w in left for h in HINTS)), float(after[:1] in ("\"", "'"))]


def rule_label(text: str, start: int, end: int, lexicon: Lexicon) -> float | None:
    """1 for a secret beyond doubt, 0 for what cannot be one, None in between."""
    token, before = text[start:end], text[max(0, start - 40):start]
    assigned = ASSIGNED.search(before)
    if KEY_FORMAT.fullmatch(token) or (assigned and assigned[1].lower() in HINTS and any(map(str.isdigit, token))):
        return 1.0
    if not assigned and (token.isdigit() or token.isalpha() or lexicon.coverage(token) > 0.6
                         or "://" in before.rpartition(" ")[2]):
        return 0.0
    return None


@dataclass
class Scanner:
    """Lexicon and trees; a tree is a list of (feature, threshold, left, right) or (share of secrets,)."""

    lexicon: Lexicon
    trees: list[list[tuple]]

    def score(self, text: str, start: int, end: int) -> float:
        """Mean share of secrets in the leaves; without trees, what the format says."""
        if not self.trees:
            return rule_label(text, start, end, self.lexicon) or 0.0
        x = features(text, start, end, self.lexicon)
        total = 0.0
        for tree in self.trees:
            node = tree[0]
            while len(node) > 1:
                node = tree[node[2] if x[node[0]] <= node[1] else node[3]]
            total += node[0]
        return total / len(self.trees)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS,
        seed: int = 9, lang: str | None = None) -> Scanner:
    """Train on the findings of a bounded sample; without findings of both kinds there are no trees.

    The dictionary is of all documents; with `lang`, words of a small language have their own share.
    """
    h = F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"))
    name = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")) if lang else F.lit("")
    there = docs.select(F.col(f"`{text}`").alias("text"), h.alias("h"), name.alias("lang")).where("text is not null")
    words = lexicon(there)
    n = max(1, there.count())
    rows = stored(thinned(there, F.col("h"), sample / n), "secrets")
    return Scanner(words, train(findings(rows, words)))


def lexicon(texts: DataFrame) -> Lexicon:
    """Dictionary words and shares of their letter pairs over all rows (text, lang)."""
    sizes = texts.groupBy("lang").agg(F.count("*").alias("docs"))
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))
    counts = (texts.select("lang", F.explode(found).alias("w")).where("length(w) <= 12")
              .groupBy("lang", "w").agg(F.count("*").alias("n")))
    enough = lambda n, docs: n >= F.greatest(F.lit(float(DICTIONARY_DOCS)), docs * DICTIONARY_SHARE)
    total = sizes.agg(F.sum("docs").alias("all_docs"))
    words = (counts.join(F.broadcast(sizes), "lang").groupBy("w")
             .agg(F.sum("n").alias("n"), F.max(enough(F.col("n"), F.col("docs"))).alias("own"))
             .join(F.broadcast(total)).where(F.col("own") | enough(F.col("n"), F.col("all_docs"))).select("w", "n"))
    seen = {r.w: r.n for r in words.collect()}
    pairs: Counter = Counter()
    for w, n in seen.items():
        for i in range(len(w) - 1):
            pairs[w[i:i + 2]] += n
    letters = sum(pairs.values()) or 1
    return Lexicon(set(seen), {p: n / letters for p, n in pairs.items()})


def findings(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """label, features of every candidate with a label."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def open_task():
        def one(content):
            found = [(rule_label(content, a, b, held.value), features(content, a, b, held.value))
                     for a, b in candidates(content)]
            return ([{"label": x, "features": f} for x, f in found if x is not None],)

        return lambda b: map(one, b["text"])

    out = arrow_columns(docs.select(F.col(f"`{text}`").alias("text")), {"text": F.col("text")},
                        "found array<struct<label:double,features:array<double>>>", open_task)
    return out.select(F.explode("found").alias("f")).select("f.label", "f.features")


def train(labelled: DataFrame, seed: int = 9) -> list[list[tuple]]:
    """Trees of a Spark random forest over labelled findings (label 0 or 1, features)."""
    rows = stored(labelled.select("label", array_to_vector("features").alias("features")), "secrets")
    if {r.label for r in rows.select("label").distinct().collect()} != {0.0, 1.0}:
        return []
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(rows)
    return [_nodes(tree._call_java("rootNode")) for tree in forest.trees]


def _nodes(root) -> list[tuple]:
    out: list[tuple] = []

    def walk(node) -> int:
        at = len(out)
        out.append(())
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            out[at] = (stats[1] / (sum(stats) or 1.0),)
        else:
            split = node.split()
            out[at] = (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()))
        return at

    walk(root)
    return out


def scan(docs: DataFrame, scanner: Scanner, text: str = "text") -> DataFrame:
    """`docs` with n_candidates, n_secrets, secrets (start, length in characters, score) and redacted.

    A null text has no candidates and stays null; an empty one likewise. Texts are read whole, and
    repeated rows are judged alike. A result column replaces one of its name.
    """
    held = docs.sparkSession.sparkContext.broadcast(scanner)

    def open_task():
        score = held.value.score

        def one(body):
            if body is None:
                return (0, 0, [], None)
            content = body.decode("utf-8", "replace")
            spans = [(a, b, score(content, a, b)) for a, b in candidates(content)]
            bad = [s for s in spans if s[2] >= SECRET_SCORE]
            parts, at = [], 0
            for a, b, _ in bad:
                parts += [content[at:a], MASK]
                at = b
            clean = "".join([*parts, content[at:]]) if bad else content
            return (len(spans), len(bad), [{"start": a, "length": b - a, "score": s} for a, b, s in bad], clean)

        return lambda b: map(one, b["text"])

    return arrow_columns(docs, {"text": text}, "n_candidates bigint, n_secrets bigint, "
                         "secrets array<struct<start:int,length:int,score:double>>, redacted string", open_task)


def redact(docs: DataFrame, scanner: Scanner, text: str = "text") -> DataFrame:
    """All documents with their own columns; every secret in the text is replaced by a mask."""
    rows, names = plain_names(docs)
    out = scan(rows, scanner, names[text])
    return out.select(*[F.col("redacted").alias(c) if c == text else
                        F.length("redacted").cast("long").alias(c) if c == "n_chars" else
                        F.col(names[c]).alias(c) for c in docs.columns])


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return scan(docs, fit(docs, lang="lang")).select("doc_id", "n_candidates", "n_secrets", "secrets")
