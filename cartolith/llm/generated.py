"""Files that were not written by hand for their repository: generated, minified, copied in, or data."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.session import BROADCAST_ROWS, broadcast_if_bounded, cut_lineage, ship_package

#: Labelled files on which the forest is trained, at most, half of them of each label; all files are scored.
TRAINING_FILES = 20_000
TREES, DEPTH = 60, 8
#: Probability from which the forest's vote counts, and share of a file that makes a copy.
LEAST_PROBABILITY, LEAST_COPIED = 0.75, 0.5
#: Words in a shingle.
SHINGLE = 5
#: Characters and tokens in a window of the local measures; windows overlap by half.
WINDOW, TOKENS = 512, 96
#: Files with a head of their own below which any file without a notice is taken for one written by hand.
LEAST_HAND = 50

FEATURES = (
    "compression",  # bytes after and before compression
    "masked_compression",  # the same with all digits alike
    "least_ratio",  # the best and worst compressed window, digits alike
    "most_ratio",
    "entropy",  # bits per token
    "evenness",  # the entropy as a share of its greatest possible value
    "least_entropy",  # the lowest and highest entropy of a window
    "most_entropy",
    "line_entropy",  # of the shapes of lines, as a share of its greatest possible value
    "line_variety",  # distinct lines, digits alike, of all lines
    "line_length",
    "longest_share",  # the longest line's share of the code outside strings
    "identifier_length",
    "short_names",  # share of identifiers of one or two letters
    "names_share",  # identifiers outside literals, of all characters but space
    "comment_density",
)
#: Further measures, which label files that are nothing but data and which the forest does not see.
CHECKS = (
    "literal_share",  # numbers and strings, of all characters but space
    "statements",  # words of definitions and control flow outside literals and comments
    "solid",  # characters but space
)

MEASURES = FEATURES + CHECKS

# Wordings by which tools and copies customarily announce themselves on comment lines at the head or foot
# of a file; a line that names a definition file and little else says what the file was made from.
TOOL_NOTICE = (
    r"(?i)\bcode generated by\b|@generated\b|<auto-?generated\b|\bauto-?generated (?:file|code|from|by|with|using|on|at)\b|"
    r"\bgenerated (?:code|file|by|from|with|using|on)\b|\bautomatically (?:produced|generated|created)\b|"
    r"\b(?:machine|computer)[- ](?:written|generated|made)\b|\bautomatisch (?:erzeugt|generiert|erstellt)\b|"
    r"\bdo not (?:modify|edit|change)(?: (?:this file|it))?(?: by hand| manually| directly)?\W*$|\bdo not (?:modify|edit|change) this file\b|"
    r"\bchanges will be (?:lost|overwritten)\b|"
    r"^\W*(?!see\b)(?:\w+[\s:]+){0,4}\(?[\w./-]+\.(?:proto|idl|graphql|gql|thrift|avsc|ya?ml|json|xsd|wsdl|fbs|capnp|g4)\)?\W*$"
)
COPY_NOTICE = (
    r"(?i)^\W*(?:@license +)?[\w.-]+ v?\d+\.\d+\.\d+(?: +(?:--|\|).*)?\W*$|\bvendored from\b|\bcopied (?:verbatim )?from\b|"
    r"\b[\w-]+@v?\d+\.\d+\.\d+|\bthird[- ]party\b|^/\*!"
)

# Names and folders that tools and package managers use.
TOOL_PATH = (
    r"(?i)(?:[._-](?:generated|autogen|gen|g|pb|pb2|pb2_grpc|pb\.gw|designer)\.\w+$|outerclass\.java$|"
    r"(?:^|/)(?:generated|autogen|gen|__generated__|generated-sources|generated-src|generated_src)/)"
)
COPY_PATH = (
    r"(?i)(?:^|/)(?:vendor|vendored|third[-_]?party|3rd[-_]?party|node_modules|godeps|externals?|extern|site-packages|"
    r"dist-packages|bower_components|jspm_packages|pods|carthage|deps|[a-z][\w.]*-v?\d+\.\d+\.\d+)/"
)
MINIFIED_PATH = r"(?i)(?:[._-]min\.\w+$|[._-](?:all|bundle|bundled|prod)\.(?:js|css|mjs|cjs)$|(?:^|/)bundle\.[0-9a-f]{6,}\.\w+$)"

_COMMENT_LINE = re.compile(r"\s*(?://|#|/\*|\*|<!--|--|;|\"\"\"|''')")
#: At the foot, indented comments belong to the code above them.
_FOOT_LINE = re.compile(r"//|#|--\s|;[;\s]")
_FOOT_BLOCKS = (("*/", "/*"), ("-->", "<!--"), ('"""', '"""'), ("'''", "'''"))
_FOOT_BLOCK = re.compile(r"/\*(?:(?!\*/).)*\*/|<!--(?:(?!-->).)*-->|(\"\"\"|''')(?:(?!\1).)*\1", re.S)
_TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\s\w]")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\b\d[\w.]*")
_IDENTIFIER = re.compile(r"[A-Za-z_]\w*")
_STATEMENT = re.compile(
    r"(?i)\b(?:func|def|fn|function|class|struct|interface|enum|trait|impl|return|if|for|while|throw|raise|switch|match)\b|=>"
)
_BLOCK = re.compile(r"/\*.*?\*/|\"\"\".*?\"\"\"|'''.*?'''", re.S)
_LINE_COMMENT = re.compile(r"(?://|#).*")
_WORD = re.compile(r"\w+")


def head_and_rest(content: str) -> tuple[str, str]:
    """The comment lines before the first line of code, and what follows them."""
    lines = content.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    k = 0
    while k < len(lines) and (not lines[k].strip() or _COMMENT_LINE.match(lines[k])):
        if lines[k].lstrip().startswith("/*!") and "*/" in lines[k] and lines[k].rstrip()[-2:] != "*/":
            break
        k += 1
    return "\n".join(lines[:k]), "\n".join(lines[k:])


def code_and_foot(rest: str) -> tuple[str, str]:
    """What follows a head without the comments after its last line of code, and those comments."""
    lines = rest.split("\n")
    k = len(lines)
    while k:
        line = lines[k - 1].rstrip()
        if not line or _FOOT_LINE.match(line):
            k -= 1
            continue
        begin = next((begin for end, begin in _FOOT_BLOCKS if line.endswith(end)), None)
        if begin is None:
            break
        opens = next((j for j in range(k - 1, -1, -1) if begin in (lines[j] if j < k - 1 else line[: -len(begin)])), None)
        if opens is None or not _FOOT_BLOCK.fullmatch("\n".join([*lines[opens : k - 1], line])):
            break
        k = opens
    return "\n".join(lines[:k]), "\n".join(lines[k:])


def _bits(counts: Counter) -> float:
    n = sum(counts.values())
    if not n:
        return 0.0
    alike = Counter(counts.values())  # few different counts
    return math.log2(n) - sum(k * c * math.log2(c) for c, k in alike.items()) / n


def _even(counts: Counter) -> float:
    n = sum(counts.values())
    return _bits(counts) / math.log2(n) if n > 1 else 1.0


def _ratio(text: str) -> float:
    raw = text.encode("utf-8", "replace")
    return len(zlib.compress(raw, 6)) / len(raw) if raw else 1.0


def measure(code: str) -> list[float]:
    """The features and checks of a file's code, which no longer has its head and foot."""
    tokens = _TOKEN.findall(code)
    counts = Counter(tokens)
    without = _BLOCK.sub("", code)
    outside = _LITERAL.sub("", without)
    comments = len(code) - len(without) + sum(map(len, _LINE_COMMENT.findall(outside)))
    solid = len(re.sub(r"\s+", "", code))
    masked = re.sub(r"\d+", "0", code)
    windows = [_ratio(masked[k : k + WINDOW]) for k in range(0, max(1, len(masked) - WINDOW // 2), WINDOW // 2)]
    plain = _TOKEN.findall(masked)
    runs = [_bits(Counter(plain[k : k + TOKENS])) for k in range(0, max(1, len(plain) - TOKENS // 2), TOKENS // 2)]
    lines = [line.strip() for line in code.split("\n") if line.strip()]
    bare = [len(_LITERAL.sub("", line)) for line in lines]
    shaped = _IDENTIFIER.sub("a", _LITERAL.sub("0", code)).split("\n")
    shapes = Counter(" ".join(line.split()) for line in shaped if line.strip())
    names = [len(x) for x in _IDENTIFIER.findall(outside)]
    literal = sum(len(x) for x in _LITERAL.findall(without))
    return [
        _ratio(code),
        _ratio(masked),
        min(windows),
        max(windows),
        _bits(counts),
        _even(counts),
        min(runs),
        max(runs),
        _even(shapes),
        len({line.strip() for line in masked.split("\n") if line.strip()}) / max(1, len(lines)),
        sum(map(len, lines)) / max(1, len(lines)),
        max(bare, default=0) / max(1, sum(bare)),
        sum(names) / max(1, len(names)),
        sum(n <= 2 for n in names) / max(1, len(names)),
        sum(names) / max(1, solid),
        comments / max(1, len(code)),
        literal / max(1, solid),
        float(len(_STATEMENT.findall(_LINE_COMMENT.sub("", outside)))),
        float(solid),
    ]


def shingle_hashes(text: str) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of five words."""
    seen: dict[str, int] = {}
    words = [seen.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in _WORD.findall(text.lower())]
    if len(words) < SHINGLE:
        return np.zeros(0, np.int64)
    h = np.array(words, np.uint64)
    out = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            out = out * np.uint64(0x9E3779B97F4A7C15) + (h[k : k + len(out)] ^ (h[k : k + len(out)] >> np.uint64(29)))
    return np.unique(out.view(np.int64))


def current_files(files: DataFrame) -> DataFrame:
    """``repo_key, path, content``: the newest row of each file, its path with plain slashes."""
    return (
        files.where(F.col("file_path").isNotNull())
        .groupBy(F.coalesce("repo_key", F.lit("")).alias("repo_key"), plain_path(F.col("file_path")).alias("path"))
        .agg(F.max_by("content", F.struct(F.col("content").isNotNull(), "mod_time")).alias("content"))
    )


def plain_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(?:\./+)+", "")


def upstream_shingles(upstream: DataFrame) -> DataFrame:
    """``upstream_id, shingle`` of the known files of outside libraries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t or "") for t in batch.column(1).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(h) for h in hashes])
            flat = np.concatenate([*hashes, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(flat)], ["upstream_id", "shingle"])

    ids = upstream.select(
        F.xxhash64(F.coalesce("lib", F.lit("")), F.coalesce("version", F.lit("")), F.coalesce("path", F.lit(""))).alias("id"),
        F.col("content").cast("string"),
    )
    return ids.mapInArrow(run, "upstream_id bigint, shingle bigint").distinct()


def file_evidence(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """``repo_key, path, empty, tool, copy, own, shingles, hits, <measures>`` of every file, in one pass over the texts.

    ``tool`` and ``copy``: the head or foot has such a notice; ``own``: it has comments, and no notice among them.

    ``hits`` are the file's shingles that an upstream file has: if the known
    files are few (at most ``BROADCAST_ROWS`` shingles) they are broadcast and
    other shingles are dropped at once; otherwise all are kept for the join.
    """
    some = upstream.select("shingle").distinct().limit(BROADCAST_ROWS + 1).toArrow().column(0).to_numpy()
    known = files.sparkSession.sparkContext.broadcast(np.sort(some) if len(some) <= BROADCAST_ROWS else None)
    tool, copy = (re.compile(p, re.M) for p in (TOOL_NOTICE, COPY_NOTICE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = known.value
        for batch in batches:
            rows = []
            for content in batch.column(2).to_pylist():
                head, code = head_and_rest(content or "")
                marked = "sourceMappingURL=" in code
                banner = code.startswith("/*!")
                code, foot = code_and_foot(code)
                ends = f"{head}\n{foot}"
                said = marked or bool(tool.search(ends))
                copied = banner or bool(copy.search(ends))
                hashes = shingle_hashes(content or "")
                hits = hashes
                if at is not None:
                    hits = hashes[at[np.minimum(np.searchsorted(at, hashes), len(at) - 1)] == hashes] if len(at) else hashes[:0]
                rows.append(
                    (
                        not (content or "").strip(),
                        said,
                        copied,
                        bool(ends.strip()) and not said and not copied,
                        len(hashes),
                        hits,
                        *measure(re.sub(r"^/\*!.*?\*/|(?://|#)# sourceMappingURL=.*", "", code, flags=re.S)),
                    )
                )
            columns = list(zip(*rows, strict=True)) if rows else [()] * (6 + len(MEASURES))
            kinds = [pa.bool_()] * 4 + [pa.int64(), pa.list_(pa.int64())] + [pa.float64()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["repo_key", "path", "empty", "tool", "copy", "own", "shingles", "hits", *MEASURES],
            )

    schema = "repo_key string, path string, empty boolean, tool boolean, copy boolean, own boolean, shingles bigint, hits array<bigint>"
    return files.mapInArrow(run, schema + "".join(f", {f} double" for f in MEASURES))


def copied_share(evidence: DataFrame, upstream: DataFrame) -> DataFrame:
    """``repo_key, path, copied``: the largest share of a file's shingles that one upstream file has."""
    hits = evidence.select("repo_key", "path", "shingles", F.explode("hits").alias("shingle"))
    shared = hits.join(broadcast_if_bounded(upstream), "shingle")
    by_file = shared.groupBy("repo_key", "path", "shingles", "upstream_id").agg(F.count("*").alias("n"))
    return by_file.groupBy("repo_key", "path").agg(F.max(F.col("n") / F.col("shingles")).alias("copied"))


def _nothing_but_data() -> Column:
    return (F.col("literal_share") >= 0.7) & (F.col("statements") == 0) & (F.col("solid") >= 400)


def labelled_files(evidence: DataFrame) -> DataFrame:
    """``repo_key, path, label, <features>``: what the forest may learn from.

    Label 1: a tool's notice in head or foot, or nothing but data (literals
    make up ``literal_share`` 0.7 of at least 400 characters and nothing is
    defined or done outside them), as data hardly ever has a notice.  Label 0:
    head or foot has comments, none of them a notice; if fewer than
    ``LEAST_HAND`` files do, any file without a notice.  What labels a file is
    none of its features: heads and feet are cut off, the checks left out.
    """
    data = _nothing_but_data()
    made = F.col("tool") | data
    silent = ~F.col("tool") & ~F.col("copy") & ~data
    own = evidence.where(~F.col("empty") & silent & F.col("own")).limit(LEAST_HAND).count() == LEAST_HAND
    hand = silent & F.col("own") if own else silent
    label = F.when(made, 1.0).when(hand, 0.0)
    return evidence.where(~F.col("empty") & label.isNotNull()).select("repo_key", "path", label.alias("label"), *FEATURES)


def train_forest(labelled: DataFrame, most: int = TRAINING_FILES) -> RandomForestClassificationModel | None:
    """A random forest on ``labelled_files``; null if there are labels of one kind only.

    Of each label the ``most`` / 2 files with the least hash of repository and
    path are taken, sorted, in one partition, so that neither the order of the
    rows nor their partitions change the trees.
    """
    key = F.xxhash64("repo_key", "path")
    parts = [labelled.where(F.col("label") == x).orderBy(key, "repo_key", "path").limit(most // 2) for x in (0.0, 1.0)]
    sample = pd.concat([p.toPandas() for p in parts], ignore_index=True)
    counts = sample["label"].value_counts()
    if len(counts) < 2:
        return None
    sample["weight"] = len(sample) / 2 / sample["label"].map(counts)
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=3,
        featureSubsetStrategy="sqrt", subsamplingRate=0.8, minInstancesPerNode=3,
    )
    rows = labelled.sparkSession.createDataFrame(sample[["label", "weight", *FEATURES]]).coalesce(1)
    return forest.fit(_vectors(rows))


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(rows)


def scored(evidence: DataFrame) -> DataFrame:
    """Add ``probability``: the vote of a forest trained on the labelled among these files; null without labels of both kinds."""
    model = train_forest(labelled_files(evidence))
    if model is None:
        return evidence.withColumn("probability", F.lit(None).cast("double"))
    return model.transform(_vectors(evidence)).withColumn("probability", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "prediction"
    )


def not_written_by_hand(symbols: DataFrame, files: DataFrame, upstream: DataFrame) -> DataFrame:
    """``repo_key, file_path, reason`` of each file named in ``symbols`` that was not written for its repository.

    The random forest decides first, on what the code looks like (reason
    ``forest``).  Ordinary code can be somebody else's all the same; what then
    shows it is outside the code's looks: ``notice`` (head or foot declare a
    tool or an origin), ``copy`` (most of its shingles of five words are those
    of one upstream file), ``data`` (by the rule that labels data, where a
    collection is too small for the forest to have learnt it), ``path`` (a name
    or folder that tools or package managers use).

    Defined cases: a file without content goes by its path, as does one whose
    rows are all null; repeated rows and several spellings of a path count
    once, the newest row with content holds; a null repository is one of its
    own; a null path is no file; empty tables give no rows; other columns are
    not read.
    """
    ship_package(symbols.sparkSession)
    named = (
        symbols.where(F.col("file_path").isNotNull())
        .select("repo_key", "file_path")
        .distinct()
        .withColumns({"_repo": F.coalesce("repo_key", F.lit("")), "path": plain_path(F.col("file_path"))})
    )
    known = cut_lineage(upstream_shingles(upstream), "upstream-shingles")
    evidence = cut_lineage(file_evidence(current_files(files), known), "file-evidence")
    judged = scored(evidence).join(copied_share(evidence, known), ["repo_key", "path"], "left")
    reason = (
        F.when((F.col("probability") >= LEAST_PROBABILITY) & ~F.col("empty"), "forest")
        .when(F.col("tool") | F.col("copy"), "notice")
        .when(F.col("copied") >= LEAST_COPIED, "copy")
        .when(_nothing_but_data() & ~F.col("empty"), "data")
    )
    judged = judged.select(
        F.col("repo_key").alias("_repo"), "path", "empty", reason.alias("reason")
    )
    by_path = (
        F.when(F.col("path").rlike(TOOL_PATH) | F.col("path").rlike(COPY_PATH), "path")
        .when(F.coalesce("empty", F.lit(True)) & F.col("path").rlike(MINIFIED_PATH), "path")
    )
    return (
        named.join(judged, ["_repo", "path"], "left")
        .withColumn("reason", F.coalesce("reason", by_path))
        .where(F.col("reason").isNotNull())
        .select("repo_key", "file_path", "reason")
    )
