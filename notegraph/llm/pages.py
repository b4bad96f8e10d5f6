"""Keyword-stuffed and link-list pages: bagged decision trees on content and link features.

Each text is cut into blocks. Rules that join several signs of a block (links, tags, short items,
sentence ends, variety of words) say of some pages surely what they are: these are the weak labels.
The trees don't see what the rules say. They see how the text spreads over each sign alone (how
much of it stands in blocks of little variety, of few sentence ends, of links, and so on) and
counts over the whole page. Bagged trees are fitted on a bounded sample, all pages are scored, and
scores are smoothed by the rate of such pages per host.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.operators.skew import salted_join
from notegraph.session import written

#: Labelled pages the trees are fitted on, at most; trees; their depth.
SAMPLE, TREES, DEPTH = 20_000, 25, 8
#: Partitions of that sample.
FIT_PARTS = 6
#: Share of stuffed material that gives a weak label.
SURE, SURELY_NOT = 0.6, 0.4
#: Pages a host counts in addition at the rate of all pages, and weight of its log odds in a score.
PRIOR, WEIGHT = 50, 0.3

#: What the rules see: shares of the text in blocks that they take for stuffing, for sentences, and for code, tables or logs.
SIGNS = ("stuffed", "prose", "structured")
#: Variety of words up to which a share of the text is measured.
VARIETIES = (0.4, 0.46, 0.52, 0.58, 0.66)
#: What the trees see.
FEATURES = (
    *(f"variety_{v}" for v in VARIETIES), "variety", "distinct_words", "linked", "link_blocks", "tagged", "tag_blocks", "endless", "sentence_rate",
    "short_items", "words_per_item", "repeated_items", "special", "digits", "marks", "log_size", "blocks",
)

_FRONT = re.compile(r"\A﻿?\s*---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)
_LINK = re.compile(r"!?\[\[[^\[\]]*\]\]|!?\[[^\[\]\n]*\]\([^()\s]*\)|<a\b[^<>]*>[^<]*</a\s*>|<?(?:https?://|www\.)[^\s<>]+>?", re.I)
_HASH = re.compile(r"(?<!\S)#[^\s#]+")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,300}>")
_END = re.compile(r"[.!?…]+[\"'”’»)\]*_]*(?=\s+[^\s\d]|\s*$)")  # "Nr. 5" ends no sentence
_ITEM = re.compile(r"[\n,;|·•]+|\s[-–—/]\s")
_BULLET = re.compile(r"(?m)^[ \t]*(?:[-*+>]|\d+[.)])[ \t]+")
_WORD = re.compile(r"[^\W\d_]+")
_LOG = re.compile(r"^\W{0,2}(?:\d{4}-\d\d-\d\d|\d\d?[:/.]\d\d|\[[\d:. -]+\])")
_CODE = re.compile(r"[(){}\[\];=<>]")
_SENTENCE = re.compile(r"[.!?…\n]+")
#: Variety of words at which a block is no text: running text has about 0.75 in windows of 50.
POOR = 0.56
#: The same for a block with sentence ends, of at least 40 words.
POORER = 0.46
_HEADING = re.compile(r"^#{1,6}\s")


def blocks(text: str) -> Iterator[tuple[str, str]]:
    """(kind, block): parts between blank lines and headings; fences, tables and logs are kinds of their own."""
    held: list[str] = []
    fence = False

    def kind(lines: list[str]) -> str:
        n = len(lines)
        if sum(x.startswith("|") and x.endswith("|") for x in (y.strip() for y in lines)) * 2 > n:
            return "table"
        if n > 1 and sum(bool(_LOG.match(x)) for x in lines) * 2 > n:
            return "log"
        return "text"

    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith(("```", "~~~")):
            if held:
                yield ("code" if fence else kind(held)), "\n".join(held)
                held = []
            fence = not fence
        elif fence:
            held.append(line)
        elif not bare or _HEADING.match(bare):
            if held:
                yield kind(held), "\n".join(held)
                held = []
            if bare:
                yield "heading", bare
        else:
            held.append(bare)
    if held:
        yield ("code" if fence else kind(held)), "\n".join(held)


def variety(words: list[str], window: int = 50) -> float:
    """Share of different words, on average over windows; of under 12 words none is told."""
    n = len(words)
    if n < 12:
        return 1.0
    parts = range(0, max(1, n - window // 2), window)
    return sum(len(set(words[i : i + window])) / min(window, n - i) for i in parts) / len(parts)


def measures(text: str) -> tuple[list[float], list[float]]:
    """The SIGNS and FEATURES of a text, from the whole of it without its frontmatter."""
    body = _FRONT.sub("", text.replace("\r\n", "\n").replace("\r", "\n"), count=1)
    total = stuffed = prose = structured = special = linked = tagged = link_blocks = tag_blocks = endless = short_items = 0
    ends_all = words_all = n_blocks = items_all = repeats_all = n_letters = 0
    varied, low, seen = 0.0, [0] * len(VARIETIES), set()
    for kind, block in blocks(body):
        size = len(block)
        if kind == "heading":
            continue
        n_blocks += 1
        total += size
        if kind != "text":
            structured += size
            special += size
            continue
        link = tag = links = tags = 0
        rest = block
        if "[" in block or "<" in block or "://" in block or "www." in block:
            found = [len(m) for m in _LINK.findall(block)]
            links, link = len(found), sum(found)
            rest = _TAG.sub(" ", _LINK.sub(" link ", block)) if links else _TAG.sub(" ", block)
            if links and "<a" in block:
                link += len(_LINK.sub("", block)) - len(_TAG.sub("", _LINK.sub("", block)))
        if "#" in block:
            found = _HASH.findall(block)
            tags, tag = len(found), sum(map(len, found))
        linked += link
        tagged += tag
        words, ends = len(rest.split()), len(_END.findall(rest))
        ends_all += ends
        words_all += words
        # a verse that comes again and again counts once
        sentences = ends * 40 >= words
        letters = _WORD.findall((" ".join(dict.fromkeys(_SENTENCE.split(rest))) if sentences else rest).lower())
        seen.update(letters)
        n_letters += len(letters)
        v = variety(letters)
        varied += v * size
        for i, most in enumerate(VARIETIES):
            if v <= most:
                low[i] += size
        if link * 2 > size:
            link_blocks += size
        if tag * 2 > size:
            tag_blocks += size
        if sentences:
            if links > 2 * ends and link * 2 > size:
                sentences = False
            elif len(letters) >= 40 and v <= POORER:
                stuffed += size
            else:
                prose += size
        else:
            endless += size
        if sentences:
            continue
        items = [x for x in (y.strip(" \t-*_") for y in _ITEM.split(_BULLET.sub("", rest))) if x]
        items_all += len(items)
        repeats_all += len(items) - len(set(items))
        if len(items) >= 5 and words <= 8 * len(items):
            short_items += size
        if (link + tag) * 2 > size and links + (tag > 0) * tags >= 5:
            stuffed += size
        elif len(_CODE.findall(rest)) * 12 > len(rest):
            structured += size
        elif v <= POOR:
            stuffed += size
    n = max(1, total)
    signs = [stuffed / n, prose / n, structured / n]
    return signs, [
        *(x / n for x in low), varied / n, len(seen) / max(1, n_letters), linked / n, link_blocks / n, tagged / n, tag_blocks / n, endless / n, ends_all / max(1, words_all),
        short_items / n, min(50.0, words_all / max(1, items_all)), repeats_all / max(1, items_all), special / n, sum(map(body.count, "0123456789")) / n,
        (body.count(",") + body.count(";") + body.count("|")) / n, float(len(str(total))) + total / 10 ** len(str(total)), float(min(n_blocks, 1000)),
    ]


def page_features(documents: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, host, signs, x): the signs and features of every text that is neither null nor empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measures(t) for t in b.column(2).to_pylist()]
            signs, x = (pa.array([r[i] for r in rows], type=pa.list_(pa.float64())) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), signs, x], names=["doc_id", "host", "signs", "x"])

    name = F.lower(F.trim(F.col(host)))
    rows = documents.where(F.col(text).isNotNull() & (F.length(text) > 0)).select("doc_id", name.alias("host"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, host string, signs array<double>, x array<double>")


def sign(name: str):
    return F.col("signs")[SIGNS.index(name)]


def feature(name: str):
    return F.col("x")[FEATURES.index(name)]


def weak_labels(features: DataFrame) -> DataFrame:
    """Features with `label`: 1 and 0 where the rules are sure; other pages are left out.

    Sure of stuffing: most of the text is lists of links, tags or repeated items, with few
    sentences, and enough of it. Sure of the contrary: mostly sentences or structured material, or
    hardly any text at all.
    """
    size = F.floor(feature("log_size"))
    yes = (sign("stuffed") >= SURE) & (sign("prose") <= 1 - SURE) & (size >= 3)
    no = (sign("stuffed") <= SURELY_NOT) & ((sign("prose") + sign("structured") >= SURE) | (size < 3))
    return features.withColumn("label", F.when(yes, 1.0).when(no, 0.0)).where("label is not null")


def stuffed_pages(documents: DataFrame, text: str = "text", host: str = "source", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score): pages mostly made of repeated keywords, links or tags, with their smoothed score.

    Null and empty texts are never among them. The trees are fitted on at most `sample` weakly
    labelled pages of each label, chosen by a hash of the id; features, scores and host rates cover
    all pages. A null host counts as one host. If the weak labels are all alike, the rules alone
    decide. Copies have equal features; they are found alike unless their hosts differ greatly and
    the trees are undecided.
    """
    features = written(page_features(documents, text, host), "features")
    labelled = weak_labels(features)
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        scored = features.select("doc_id", "host", sign("stuffed").alias("p"))
    else:
        parts = [
            labelled.where(F.col("label") == label).where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // sample))) == 0).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample)
            for label, n in sorted(counts.items())
        ]
        train = parts[0].unionByName(parts[1]).select("label", array_to_vector("x").alias("features")).repartition(FIT_PARTS)
        trees = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="all", subsamplingRate=1.0, seed=5, minInstancesPerNode=5)
        model = trees.fit(train)
        scored = model.transform(features.withColumn("features", array_to_vector("x"))).select("doc_id", "host", vector_to_array("probability")[1].alias("p"))
    scored = written(scored.withColumn("host", F.coalesce("host", F.lit("")))  , "scores")
    total = scored.agg(F.avg((F.col("p") > 0.5).cast("double")).alias("overall"))
    hosts = scored.groupBy(F.col("host").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("p") > 0.5).cast("double")).alias("k"))
    hosts = hosts.crossJoin(F.broadcast(total)).select("name", "overall", ((F.col("k") + PRIOR * F.col("overall")) / (F.col("n") + PRIOR)).alias("rate"))

    def odds(c):
        c = F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
        return F.log(c / (1 - c))

    smooth = salted_join(scored, hosts, "host", "name", salt_by="doc_id")
    logit = odds(F.col("p")) + WEIGHT * (odds(F.col("rate")) - odds(F.col("overall")))
    return smooth.select("doc_id", (1 / (1 + F.exp(-logit))).alias("score")).where("score > 0.5")
