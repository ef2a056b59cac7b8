"""Secret scans over a trigram inverted index.

Each rule's regex gives a Boolean trigram query: an OR of ANDs of trigrams that any match
must hold. A clause needs its two rarest only to be selective, so the index has a posting
(trigram, text key) for each of those that a text holds, and rules added later add postings
of their own trigrams (`extend_index`). Intersecting postings leaves candidate texts by
rule, which the regex verifies; a rule without mandatory trigrams is run over every text.
Index and scan are DataFrame expressions only.

TextIndex keeps the postings of all trigrams of the texts themselves in a folder, for rules
that nobody knows yet.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markweave.llm.common import saved, text_of
from markweave.storage import Generations

#: Rows of candidates that may be broadcast (some 10 MB); more are joined by a shuffle.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret. least: code points that `group` of a match must have."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The contract's three kinds, then public token formats.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),  # the maximal runs of 32 and more
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def trigram_query(regex: str, most: int = 64) -> list[frozenset[str]] | None:
    """The query in lower case, as a list of alternatives, each a set of trigrams that must
    all be there; None if a match needs no trigram.

    A part of the regex is either a set of all strings that it can match, or a query. Sets
    are joined while they stay under `most` strings; a part without such a set ends a run,
    which then must occur as one of its strings.
    """
    tree = re._parser.parse(regex)  # the standard library's own parser

    def run_query(strings: set[str]) -> list[frozenset[str]] | None:
        grams = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
        return None if not all(grams) else grams

    def both(a, b):
        if a is None or b is None:
            return a if b is None else b
        met = {x | y for x, y in product(a, b)}
        return sorted(met, key=sorted) if len(met) <= most else min(a, b, key=len)

    def sequence(items) -> tuple[set[str] | None, list | None]:
        """(all strings or None, query of what is not in them)."""
        run, query, whole = {""}, None, True
        for op, arg in items:
            strings, inner = part(str(op), arg)
            query = both(query, inner)
            joined = {a + b for a, b in product(run, strings)} if strings is not None and len(run) * len(strings) <= most else None
            if joined is None:
                query, run, whole = both(query, run_query(run)), strings if strings is not None else {""}, False
            else:
                run = joined
        if whole:
            return run, query
        return None, both(query, run_query(run))

    def part(op: str, arg) -> tuple[set[str] | None, list | None]:
        if op == "LITERAL":
            return {chr(arg).lower()}, None
        if op == "IN":
            chars: set[str] = set()
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    chars.add(chr(x).lower())
                elif str(kind) == "RANGE" and x[1] - x[0] < 8:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None, None
            return (chars, None) if len(chars) <= 8 else (None, None)
        if op == "SUBPATTERN":
            return sequence(arg[-1])
        if op == "BRANCH":
            found = [sequence(x) for x in arg[1]]
            if all(s is not None and q is None for s, q in found):
                return set().union(*(s for s, _ in found)), None
            queries = [both(q, None if s is None else run_query(s)) for s, q in found]
            return None, None if any(q is None for q in queries) else [c for q in queries for c in q]
        if op == "MAX_REPEAT":
            low, high, inside = arg
            if (low, high) == (0, 1):
                strings, inner = sequence(inside)
                return (strings | {""}, None) if strings is not None and inner is None else (None, None)
            if low >= 1:
                strings, inner = sequence(inside)
                return None, both(inner, None if strings is None else run_query(strings))
        return None, None

    strings, query = sequence(tree)
    return both(query, None if strings is None else run_query(strings))


#: Letters of common text, the most frequent first: fixed, as an index must outlive a corpus.
FREQUENT = "etaoinsrhldcumfpgwybvkxjqz"


def index_query(regex: str, per_clause: int = 2) -> list[frozenset[str]] | None:
    """trigram_query with the rarest trigrams of each clause only, repeats dropped."""
    query = trigram_query(regex)
    if query is None:
        return None
    rarity = lambda g: (-sum(len(FREQUENT) if c not in FREQUENT else FREQUENT.index(c) for c in g), g)
    out = {frozenset(sorted(c, key=rarity)[:per_clause]) for c in query}
    return sorted((c for c in out if not any(d < c for d in out)), key=sorted)


def dictionary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({g for r in rules for c in index_query(r.regex) or [] for g in c})


def _text_key(docs: DataFrame) -> Column:
    """Copies of a text share their postings; a clash of keys only adds a candidate."""
    return F.xxhash64(text_of(docs))


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, known: tuple[Rule, ...] = ()) -> DataFrame:
    """The postings (trigram, text_key) of all trigrams of the rules' index queries, without
    those that an index for the rules `known` has."""
    grams = [g for g in dictionary(rules) if g not in set(dictionary(known))]
    low = docs.select(_text_key(docs).alias("text_key"), F.lower(text_of(docs)).alias("_t"))
    if not grams:
        return low.select(F.lit("").alias("trigram"), "text_key").limit(0)
    held = F.array_compact(F.array(*[F.when(F.contains("_t", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("text_key", F.explode(held).alias("trigram")).select("trigram", "text_key")


def extend_index(postings: DataFrame, docs: DataFrame, known: tuple[Rule, ...], more: tuple[Rule, ...]) -> DataFrame:
    """postings of an index for the rules `known`, and those that the rules `more` add."""
    return postings.unionByName(build_index(docs, more, known))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(text_key, rules bitmap): texts whose postings satisfy a rule's query."""
    queries = {i: q for i, r in enumerate(rules) if (q := index_query(r.regex))}
    grams = sorted({g for q in queries.values() for c in q for g in c})
    words = -(-max(1, len(grams)) // 62)
    bit = {g: divmod(i, 62) for i, g in enumerate(grams)}
    known = F.create_map(*[x for g in grams for x in (F.lit(g), F.lit(bit[g][0] * 62 + bit[g][1]))]) if grams else F.lit(None).cast("map<string,int>")
    place = postings.withColumn("_p", known[F.col("trigram")]).where("_p IS NOT NULL")
    # A list of a text is an OR of its postings' bits, which is done before the shuffle.
    lists = place.groupBy("text_key").agg(
        *[F.bit_or(F.when(F.floor(F.col("_p") / 62) == w, F.expr(f"shiftleft(1L, _p - {62 * w})")).otherwise(F.lit(0).cast("long"))).alias(f"_m{w}") for w in range(words)]
    )

    def clause(c: frozenset[str]) -> Column:
        need = [sum(1 << bit[g][1] for g in c if bit[g][0] == w) for w in range(words)]
        tests = [F.col(f"_m{w}").bitwiseAND(F.lit(n)) == n for w, n in enumerate(need) if n]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    mask = F.lit(0)
    for i, q in queries.items():
        any_of = clause(q[0])
        for c in q[1:]:
            any_of = any_of | clause(c)
        mask = mask + F.when(any_of, 1 << i).otherwise(0)
    return lists.select("text_key", mask.alias("rules")).where("rules > 0")


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """array<struct<start, kind, end>> of a rule's matches: what lies between matches, and
    the matches, give the places in code points."""
    between, found = F.split(text, rule.regex, -1), F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else found
    sizes = F.zip_with(F.zip_with(F.slice(between, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"))), group, lambda x, g: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), F.length(g).alias("part")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["part"] >= rule.least, F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    state = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.when(text.rlike(rule.regex), F.aggregate(sizes, state, step, lambda s: s["out"])).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, postings: DataFrame | None = None) -> DataFrame:
    """docs' doc_id and text, with spans: array of (start, kind as its place in rules, end)
    by start and kind, of every row. A null text is empty and has no spans. postings: those
    of an index of docs for rules that include these; without them one is built.

    Rows with the same text are candidates together; a null or repeated doc_id matters to
    nothing here. Other columns of docs are not used, whatever their names.
    """
    postings = saved(build_index(docs, rules), "postings") if postings is None else postings
    found = saved(candidates(postings, rules), "candidates")
    small = found.count() <= BROADCAST_ROWS
    keyed = docs.select("doc_id", text_of(docs).alias("text"), _text_key(docs).alias("text_key"))
    rows = keyed.join(F.broadcast(found) if small else found, "text_key", "left")
    parts = []
    for i, rule in enumerate(rules):
        spans = _spans(F.col("text"), i, rule)
        if index_query(rule.regex) is not None:
            spans = F.when(F.coalesce("rules", F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0, spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))
        parts.append(spans)
    return rows.select("doc_id", "text", F.array_sort(F.concat(*parts)).alias("spans"))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, n_<kind> of the base rules, base_sha256, spans as text."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = [i for i, r in enumerate(rules) if r.base]
    say = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    rows = scan(docs, rules)
    return rows.select(
        "doc_id",
        *[F.size(F.expr(f"filter(spans, x -> x.kind = {i})")).cast("long").alias(f"n_{rules[i].kind}") for i in base],
        F.sha2(say(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        say(F.col("spans")).alias("spans"),
    )


class TextIndex:
    """Postings (trigram, text_key) of all trigrams of each distinct text, in lower case, laid
    out by trigram in a folder, with the texts and the documents that have them.

    Documents come in generations, each put in place by one rename, and a text is split
    once, however many documents have it or bring it again. A rule, also a new one, reads the
    postings of its own trigrams only, and its regex runs on the texts that these leave;
    a rule without mandatory trigrams runs on all texts. Null texts are empty and never
    match; ids may be null or repeat, and a document that is added twice is there twice.
    """

    DOCS = "doc_id long, digest binary, gen string"
    TEXTS = "digest binary, text_key long, text string, gen string"
    POSTINGS = "trigram string, text_key long, gen string, bucket int"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.tables, self.buckets = Generations(spark, path), buckets
        for e in self.tables.live():
            self.buckets = e["buckets"]

    def _bucket(self, trigram: Column) -> Column:
        return F.pmod(F.xxhash64(trigram), F.lit(self.buckets)).cast("int").alias("bucket")

    def add(self, docs: DataFrame) -> None:
        gen = self.tables.begin()
        rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).where("text <> ''")
        rows = rows.select("doc_id", F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("digest"), F.xxhash64("text").alias("text_key"), "text")
        held = self.tables.read("texts", self.TEXTS).select("digest")
        texts = saved(rows.drop("doc_id").dropDuplicates(["digest"]).join(held, "digest", "left_anti"), "texts")
        # A look ahead takes the three characters at every place.
        grams = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("(?s)(?=(.{3}))"), F.lit(1)))
        postings = texts.select(F.explode(grams).alias("trigram"), "text_key").select("trigram", "text_key", self._bucket(F.col("trigram")))
        # By ranges, so that the list of a trigram that all texts hold is written by many tasks.
        by = ["bucket", "trigram", "text_key"]
        self.tables.write(gen, "postings", postings.repartitionByRange(*by).sortWithinPartitions(*by), "bucket")
        self.tables.write(gen, "texts", texts)
        self.tables.write(gen, "docs", rows.select("doc_id", "digest"))
        self.tables.publish(gen, buckets=self.buckets)

    def postings(self, rules: tuple[Rule, ...]) -> DataFrame:
        """(trigram, text_key) of the rules' trigrams, from the buckets that can hold them."""
        grams = dictionary(rules)
        spark = self.tables.spark
        buckets = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(self._bucket(F.col("g"))).distinct().collect()] if grams else []
        return self.tables.read("postings", self.POSTINGS).where(F.col("bucket").isin(buckets) & F.col("trigram").isin(grams)).select("trigram", "text_key")

    def candidate_texts(self, rules: tuple[Rule, ...], postings: DataFrame) -> DataFrame:
        """(digest, text) of the texts that the rules' regexes run on."""
        texts = self.tables.read("texts", self.TEXTS)
        if not all(index_query(r.regex) for r in rules):
            return texts.select("digest", "text")
        found = saved(candidates(postings, rules).select("text_key"), "candidates")
        few = found.count() <= BROADCAST_ROWS
        return texts.join(F.broadcast(found) if few else found, "text_key", "left_semi").select("digest", "text")

    def find(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(doc_id, spans) of the documents with any, spans as scan() gives them."""
        postings = saved(self.postings(rules), "postings")
        texts = self.candidate_texts(rules, postings).withColumnRenamed("digest", "doc_id")
        found = scan(texts, rules, postings).where(F.size("spans") > 0).select(F.col("doc_id").alias("digest"), "spans")
        return self.tables.read("docs", self.DOCS).join(found, "digest").select("doc_id", "spans")
