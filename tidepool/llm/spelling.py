"""Groups of spelling variants: words one edit apart, found by Aho-Corasick automata over halves of words.

One edit leaves one half of a word as it was: its first half at the start of the other word, or its second half at the end.
Words are dealt out by the first or last code points of a half, so that a shard's automaton holds the halves of the words
that can match there; every word is scanned in the shards of its own beginning and end. A match counts if it lies at the
start (or end) and the lengths differ by one at most. As a single edit then lies in the rest of the word, and leaves one
half of the rest as it was, the rest's own halves pick the words whose distance is checked.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_side, settle, table
from .vectors import parts

RUN = re.compile("[a-zÀ-ÿ]+").findall  # of texts whose A-Z are lower-cased
KEPT = 1 << 17  # different words that a task counts before it hands them on
LEAST_LENGTH = 5  # code points; halves have at least two


def counts(docs: DataFrame, modulus: int = 97) -> DataFrame:
    """word, n: how often each run of letters occurs in all texts, A-Z lower-cased.

    Where crc32 of ``<doc_id>:<run>`` is a multiple of ``modulus``, the run loses the code point of that number modulo its
    length. Null texts have no runs; a null doc_id counts as an empty string.
    """

    def run(batches):
        seen: Counter = Counter()
        whole = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for at in range(batch.num_rows):  # a text at a time, as each can be long
                doc_id, text = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(RUN(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % modulus == 0:
                        h %= len(word)
                        word = word[:h] + word[h + 1 :]
                    seen[word] += n
                if len(seen) >= KEPT:
                    yield whole()
                    seen.clear()
        yield whole()

    return docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point leads from a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class Halves:
    """An automaton over the first (side 0) or second (side 1) halves of words, and the words by half, length and quarter."""

    def __init__(self, side: int, words: dict[str, int]):
        self.side, self.n = side, words
        self.by: dict = defaultdict(list)
        self.find = ahocorasick.Automaton()
        for word in words:
            half = word[: len(word) // 2] if side == 0 else word[len(word) // 2 :]
            self.find.add_word(half, half)
            for part, quarter in enumerate(self.quarters(word, len(word), len(half))):
                self.by[half, len(word), part, quarter].append(word)
        self.find.make_automaton()
        self.close: dict = {}

    def quarters(self, word: str, length: int, half: int) -> tuple[str, str]:
        """What a word shares with one of ``length`` code points if the edit lies in the second or in the first half of the rest."""
        rest = length - half
        first, second = rest // 2, rest - rest // 2
        if self.side == 0:
            return word[half : half + first], word[len(word) - second :]
        return word[:first], word[len(word) - half - second : len(word) - half]

    def among(self, key, word: str):
        """The words of a key that are one edit from ``word``; of many, only those that share all but one code point."""
        group = self.by[key]
        if len(group) <= 64:
            return [w for w in group if one_edit(w, word)]
        if key not in self.close:
            self.close[key] = without = defaultdict(list)
            for w in group:
                for form in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
                    without[form].append(w)
        forms = {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}
        return [w for w in {w for f in forms for w in self.close[key].get(f, ())} if one_edit(w, word)]

    def near(self, word: str) -> set[str]:
        """The shard's words one edit from ``word`` that this side is to report: the second halves leave out what the first ones find."""
        size, out = len(word), set()
        for end, half in self.find.iter(word):
            k = len(half)
            if end + 1 != (k if self.side == 0 else size):
                continue
            for length in (size - 1, size, size + 1):
                if (length // 2 if self.side == 0 else length - length // 2) != k:
                    continue
                for part, quarter in enumerate(self.quarters(word, length, k)):
                    key = (half, length, part, quarter)
                    if key in self.by:
                        out.update(self.among(key, word))
        if self.side == 1:
            out = {w for w in out if not word.startswith(w[: len(w) // 2])}
        return out


def _width(half):
    """How many code points of a half deal it out: 2, 4 or 6 (a Python number or a column)."""
    if isinstance(half, int):
        return 2 if half < 4 else 4 if half < 6 else 6
    return F.when(half < 4, 2).when(half < 6, 4).otherwise(6)


def near_words(words: DataFrame, shard: int = 8192) -> DataFrame:
    """word, n_near, and form with form_n (the near word of largest n, ties to the smaller word) for words(word, n) with near ones.

    Words are distinct and of at least five code points. Routes with more than ``shard`` halves are cut into several
    automata by hash, each of which scans all words of the route; nothing is left out.
    """
    size = F.length("word")
    route = lambda side, width: F.struct(F.lit(side).alias("side"), (F.substring(F.col("word"), F.lit(1), width) if side == 0 else F.substring(F.col("word"), -width, width)).alias("route"))
    half = lambda side, length: F.floor(length / 2).cast("int") if side == 0 else (length - F.floor(length / 2)).cast("int")
    own = words.select("word", "n", F.explode(F.array(*[route(s, _width(half(s, size)).cast("int")) for s in (0, 1)])).alias("at"))
    full = own.groupBy("at").agg(F.count("*").alias("halves")).select("at", F.ceil(F.col("halves") / shard).cast("int").alias("cuts"))
    near = [F.array_distinct(F.array(*[route(s, _width(half(s, size + more)).cast("int")) for more in (-1, 0, 1)])) for s in (0, 1)]
    scan = words.select("word", "n", F.explode(F.concat(*near)).alias("at"))
    full = join_side(full)
    own = own.join(full, "at").select("word", "n", "at", F.pmod(F.xxhash64("word"), "cuts").cast("int").alias("cut"), F.lit(0).alias("role"))
    scan = scan.join(full, "at").select("word", "n", "at", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.lit(1).alias("role"))
    rows = own.unionByName(scan).select("at.side", "at.route", "cut", "role", "word", "n")
    dealt = rows.repartition(parts(rows), "side", "route", "cut").sortWithinPartitions("side", "route", "cut", "role")
    names = ["word", "n_near", "form", "form_n"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        at, halves, own = None, None, {}
        for batch in batches:
            out = []
            for side, route, cut, role, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (side, route, cut) != at:
                    at, halves, own = (side, route, cut), None, {}
                if role == 0:
                    own[word] = n
                    continue
                if not own:
                    continue
                halves = halves or Halves(side, own)  # a shard's halves come before the words it scans
                found = halves.near(word)
                if found:
                    form = min(found, key=lambda w: (-own[w], w))
                    out.append((word, len(found), form, own[form]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    found = dealt.mapInArrow(run, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.form", (-F.col("b.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for forms(word, form): each word's last form, by doubling the way that is followed each round.

    Every form occurs at least twice as often as its word, so that a way has at most log2 of the largest count steps.
    """
    now = settle(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not now.filter("moved").isEmpty():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = now.select("word", "root").join(join_side(ahead), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        last, now = now, settle(further)
        discard(last)
    return now.select("word", "root")


def variants(docs: DataFrame, least: int = 3, modulus: int = 97, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of docs(doc_id, text) with >= 5 code points and >= ``least`` occurrences.

    A word's form is its near word of largest n if that is at least ``ratio`` times its own. Null and empty texts have no
    words; texts of any length are read whole; repeated rows count each; null doc_ids count as an empty string; other
    columns are ignored; an empty table gives an empty result.
    """
    words = settle(counts(docs, modulus).filter((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= least)))
    near = settle(near_words(words))
    known = words.join(near, "word", "left").withColumn("fits", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False)))
    known = settle(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), F.col("form")).alias("form"), F.when(F.col("fits"), F.col("form_n")).alias("form_n")))
    ends = roots(known.filter("form is not null"))
    return known.join(join_side(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS k, hex(encode(doc_id || ':' || run)) AS x FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, k, xor(list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM each, bits),
formed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM formed GROUP BY word HAVING length(word) >= 5 AND sum(k) >= 3),
places AS (SELECT word, n, unnest(range(length(word))) AS p FROM words),
shorter AS MATERIALIZED (SELECT DISTINCT word, n, substr(word, 1, p) || substr(word, p + 2) AS s FROM places),
masked AS MATERIALIZED (SELECT word, n, substr(word, 1, p) || '*' || substr(word, p + 2) AS m FROM places),
near AS (SELECT a.word, b.word AS other, b.n FROM masked a JOIN masked b ON a.m = b.m AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.s = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.s = b.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -n, w := other)) AS b FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 2 * w.n THEN b.w END AS form, CASE WHEN -b.m >= 2 * w.n THEN -b.m END AS form_n FROM words w LEFT JOIN best USING (word)),
way AS (SELECT word, word AS here, 0 AS steps FROM forms UNION ALL SELECT way.word, f.form, steps + 1 FROM way JOIN forms f ON f.word = way.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, max_by(here, steps) AS root FROM way GROUP BY word) r USING (word)
"""
