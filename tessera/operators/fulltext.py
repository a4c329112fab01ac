"""Full text: analyzers, the query language, its tree and rewrites, BM25 as Columns, and postings for a persistent index.

    query  := or                              OR < AND = NOT < adjacency < + -
    or     := and ( OR and )*
    and    := seq ( AND [NOT] seq | NOT seq )*
    seq    := ( [+|-] atom )+                 adjacent atoms: the default operator
    atom   := term | "phrase" | ( or )        field:term and term^2 are refused
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidArgument, NotSupported
from tessera.functions.metrics import let
from tessera.schema import MAX_TOPK

# Fixed values of the score.
K1, B = 1.2, 0.75
#: Terms of more bytes are left out of the standard analyzer's result, but count as positions.
LONGEST = 255
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Letters and digits as they are, all other bytes as blanks; the same with A-Z lowered.
ALNUM = bytes(b if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
LOWER_ALNUM = bytes(b + 32 if 65 <= b <= 90 else b for b in ALNUM)

# --- analyzers ----------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Analyzer:
    """Splits a text column into terms; the same for a query's text on the driver."""

    tokenizer: str = "standard"
    lowercase: bool = True
    longest: int = LONGEST

    @staticmethod
    def of(index) -> Analyzer:
        """That of a full-text index. Its extra_params are a JSON object, in which max_token_length may give the greatest number of bytes
        of a term; what isn't a whole number above 0 leaves the default."""
        try:
            extra = json.loads(index.extra_params) if index.extra_params else {}
        except ValueError as e:
            raise InvalidArgument(f"extra_params {index.extra_params!r}") from e
        if not isinstance(extra, dict):
            raise InvalidArgument(f"extra_params {index.extra_params!r}")
        longest = extra.get("max_token_length")
        return Analyzer(index.tokenizer_name, "lowercase" in index.filters, longest if type(longest) is int and longest > 0 else LONGEST)

    def column(self, text: Column) -> Column:
        """Terms in order, null where a position has no term."""
        if self.tokenizer not in TOKENIZERS:
            raise NotSupported(f"tokenizer {self.tokenizer}")
        terms = TOKENIZERS[self.tokenizer][0](text)
        if self.lowercase:
            terms = F.transform(terms, lambda t: F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        return F.transform(terms, lambda t: F.when(F.octet_length(t) <= self.longest, t))

    def splitter(self) -> Callable[[str], list[str | None]]:
        """As column(), for one text: a function that carries its tokenizer with it to the executors."""
        if self.tokenizer not in TOKENIZERS:
            raise NotSupported(f"tokenizer {self.tokenizer}")
        words, lowercase, longest = TOKENIZERS[self.tokenizer][1], self.lowercase, self.longest

        def split(text: str) -> list[str | None]:
            out = words(text.translate(LOWER) if lowercase else text)
            return [t if len(t) * 4 <= longest or len(t.encode("utf-8", "surrogatepass")) <= longest else None for t in out]

        return split

    def byte_splitter(self) -> Callable[[str], list[bytes | None]]:
        """The same terms as UTF-8. Those of the standard tokenizer are runs of certain bytes: no character needs to be looked at."""
        if self.tokenizer != "standard":
            split = self.splitter()
            return lambda text: [None if t is None else t.encode("utf-8", "surrogatepass") for t in split(text)]
        longest, table = self.longest, LOWER_ALNUM if self.lowercase else ALNUM

        def split(text: str) -> list[bytes | None]:
            words = text.encode("utf-8", "surrogatepass").translate(table).split()
            if len(text) > longest and words and max(map(len, words)) > longest:
                return [w if len(w) <= longest else None for w in words]
            return words

        return split

    def positions(self, text: str) -> list[str | None]:
        return self.splitter()(text)

    def terms(self, text: str) -> list[str]:
        return [t for t in self.positions(text) if t is not None]


#: For each tokenizer: terms of a column, terms of a text.
TOKENIZERS: dict[str, tuple[Callable[[Column], Column], Callable[[str], list[str]]]] = {
    "standard": (lambda c: F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)"), 1), lambda s: re.findall("[A-Za-z0-9]+", s)),
    "whitespace": (lambda c: F.filter(F.split(c, "[ \t\n\x0b\f\r]+"), lambda t: t != ""), lambda s: [t for t in re.split("[ \t\n\x0b\f\r]+", s) if t]),
}


def register_tokenizer(name: str, column: Callable[[Column], Column], words: Callable[[str], list[str]]) -> None:
    """Add a tokenizer, e.g. a dictionary segmenter: as a function of a column, and of a text. The second is sent to the executors with
    what uses it."""
    TOKENIZERS[name] = (column, words)


# --- the query's tree -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    text: str
    boost: float = 1.0


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    boost: float = 1.0


@dataclass(frozen=True)
class Or:
    parts: tuple
    boost: float = 1.0


@dataclass(frozen=True)
class And:
    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()
    boost: float = 1.0


@dataclass(frozen=True)
class Empty:
    pass


@dataclass(frozen=True)
class _Marked:
    """+atom or -atom, until its sequence is built."""

    sign: str
    node: object = field(default=None)


LEX = re.compile(
    r'\s+|(?P<phrase>"(?:[^"\\\r\n]|\\.)*")|(?P<sign>[+-])|(?P<lp>\()|(?P<rp>\))|(?P<colon>:)|(?P<caret>\^)'
    r"|(?P<word>[A-Za-z0-9_\u0080-￿](?:[A-Za-z0-9_\u0080-￿._#/%\-'@]|\\[-+=&|!(){}\[\]^\"~*?:\\/])*)|(?P<other>.)",
    re.S,
)


def _lex(text: str) -> list[tuple[str, str]]:
    out = []
    for m in LEX.finditer(text):
        if m.lastgroup:
            word = m.group()
            kind = m.lastgroup
            if kind == "word" and word.lower() in ("or", "and", "not"):
                kind = word.lower()
            out.append((kind, word))
    return [*out, ("end", "")]


def parse(text: str, analyzer: Analyzer = Analyzer(), default_operator: str = "or"):  # noqa: B008
    """The tree of a query, not yet simplified."""
    tokens, at = _lex(text), 0

    def peek() -> str:
        return tokens[at][0]

    def step() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1][1]

    def ors():
        parts = [ands()]
        while peek() == "or":
            step()
            parts.append(ands())
        return Or(tuple(parts)) if len(parts) > 1 else parts[0]

    def ands():
        first = seq()
        must, must_not = [first], []
        while peek() in ("and", "not"):
            negated = peek() == "not"
            step()
            if not negated and peek() == "not":
                step()
                negated = True
            (must_not if negated else must).append(seq())
        return And(tuple(must), (), tuple(must_not)) if len(must) + len(must_not) > 1 else first

    def seq():
        parts = []
        while peek() in ("sign", "word", "phrase", "lp", "other", "caret", "colon"):
            parts.append(unary())
        if not parts:
            raise InvalidArgument(f"full-text query: term expected, found {tokens[at][1] or 'the end'!r}")
        if len(parts) == 1:
            return parts[0]
        if default_operator == "and":
            plain = tuple(p for p in parts if not isinstance(p, _Marked))
            return And(plain + tuple(p.node for p in parts if isinstance(p, _Marked) and p.sign == "+"), (), tuple(p.node for p in parts if isinstance(p, _Marked) and p.sign == "-"))
        return Or(tuple(parts))

    def unary():
        if peek() == "sign":
            return _Marked(step(), atom())
        return atom()

    def atom():
        kind = peek()
        if kind == "lp":
            step()
            out = ors()
            if peek() != "rp":
                raise InvalidArgument("full-text query: ) expected")
            step()
        elif kind == "phrase":
            terms = analyzer.terms(re.sub(r"\\(.)", r"\1", step()[1:-1]))
            out = Empty() if not terms else Term(terms[0]) if len(terms) == 1 else Phrase(tuple(terms))
        elif kind in ("word", "other"):
            word = step()
            if peek() == "colon":
                raise InvalidArgument("full-text query: field prefixes aren't supported")
            terms = analyzer.terms(re.sub(r"\\(.)", r"\1", word))
            out = Empty() if not terms else Term(terms[0]) if len(terms) == 1 else combine([Term(t) for t in terms], default_operator)
        else:
            raise InvalidArgument(f"full-text query: unexpected {tokens[at][1] or 'end'!r}")
        if peek() == "caret":
            raise InvalidArgument("full-text query: boosts aren't supported")
        return out

    out = ors()
    if peek() != "end":
        raise InvalidArgument(f"full-text query: unexpected {tokens[at][1]!r}")
    return out


def combine(parts: list, operator: str):
    return And(tuple(parts)) if operator == "and" else Or(tuple(parts))


def match(text: str, analyzer: Analyzer = Analyzer(), default_operator: str = "or"):  # noqa: B008
    """The tree of plain words."""
    terms = [Term(t) for t in analyzer.terms(text)]
    return Empty() if not terms else terms[0] if len(terms) == 1 else combine(terms, default_operator)


def _unique(parts: list) -> list:
    """Equal siblings as one, boosts added."""
    out: dict = {}
    for p in parts:
        if isinstance(p, Empty):
            continue
        bare = replace(p, boost=1.0)
        out[bare] = out.get(bare, 0.0) + p.boost
    return [replace(p, boost=b) for p, b in out.items()]


def simplify(node, root: bool = True):
    """The tree in normal form: nested groups flattened, equal siblings merged, empty parts dropped; an OR with signs becomes
    an AND; what can't match is Empty."""
    if isinstance(node, _Marked):
        if node.sign == "-":
            if root:
                raise InvalidArgument("full-text query: nothing but an exclusion")
            return node
        return simplify(node.node, root)
    if isinstance(node, Or):
        parts = [p for p in node.parts]
        if any(isinstance(p, _Marked) for p in parts):
            must = tuple(p.node for p in parts if isinstance(p, _Marked) and p.sign == "+")
            must_not = tuple(p.node for p in parts if isinstance(p, _Marked) and p.sign == "-")
            plain = tuple(p for p in parts if not isinstance(p, _Marked))
            if must:
                return simplify(And(must, plain, must_not, node.boost), root)
            if not plain:
                return Empty()
            return simplify(And((Or(plain),), (), must_not, node.boost), root)
        done = []
        for p in parts:
            s = simplify(p, False)
            done += [replace(x, boost=x.boost * s.boost) for x in s.parts] if isinstance(s, Or) else [s]
        done = _unique(done)
        if not done:
            return Empty()
        return replace(done[0], boost=done[0].boost * node.boost) if len(done) == 1 else Or(tuple(done), node.boost)
    if isinstance(node, And):
        must, should, must_not = [], list(node.should), list(node.must_not)
        for p in node.must:
            if isinstance(p, _Marked) and p.sign == "-":
                must_not.append(p.node)
                continue
            s = simplify(p, False)
            if isinstance(s, Empty):
                if not isinstance(p, Empty):
                    return Empty()
                continue
            if isinstance(s, And) and s.boost == 1:
                must += s.must
                should += s.should
                must_not += s.must_not
            else:
                must.append(s)
        must = _unique(must)
        should = _unique([simplify(p, False) for p in should])
        must_not = _unique([simplify(p.node if isinstance(p, _Marked) else p, False) for p in must_not])
        bare = {replace(p, boost=1.0) for p in must}
        if not must or bare & {replace(p, boost=1.0) for p in must_not}:
            return Empty()
        if len(must) == 1 and not should and not must_not:
            return replace(must[0], boost=must[0].boost * node.boost)
        return And(tuple(must), tuple(should), tuple(must_not), node.boost)
    return node


def terms_of(node) -> list[str]:
    """All terms whose statistics a query needs, sorted."""
    if isinstance(node, Term):
        return [node.text]
    if isinstance(node, Phrase):
        return sorted(set(node.terms))
    parts = node.parts if isinstance(node, Or) else (*node.must, *node.should, *node.must_not) if isinstance(node, And) else ()
    return sorted({t for p in parts for t in terms_of(p)})


# --- scoring ------------------------------------------------------------------------------------------------------------------------


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log((n - df + 0.5) / (df + 0.5) + 1))


def term_weight(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _counter(analyzer: Analyzer, terms: list[str], phrases: list[tuple[str, ...]]) -> Callable[[str | None], list[int] | None]:
    """Function from a text to: how many terms it has, how many of each of `terms`, and 1 or 0 for each of `phrases`."""
    split, wanted, runs = analyzer.byte_splitter(), [t.encode() for t in terms], [[t.encode() for t in p] for p in phrases]

    def count(text: str | None) -> list[int] | None:
        if text is None:
            return None
        words = split(text)
        out = [len(words) - words.count(None), *map(words.count, wanted)]
        for run in runs:
            there, at = 0, -1
            try:
                while not there:
                    at = words.index(run[0], at + 1)
                    there = int(words[at : at + len(run)] == run)
            except ValueError:
                pass
            out.append(there)
        return out

    return count


def facts(text: Column, analyzer: Analyzer, terms: list[str], phrases: list[tuple[str, ...]] = ()) -> Column:
    """_counter() as a Column, an array of ints. An Arrow-batched UDF: splitting bytes takes a small part of what a regular expression
    for each row takes."""

    count = _counter(analyzer, terms, list(phrases))

    @F.pandas_udf("array<int>")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(count)

    return counted(text)


def _stored_facts(tokens: Column, terms: list[str], phrases: list[tuple[str, ...]]) -> Column:
    """The same from a column with the terms in order, null where a position has none."""

    def has(form: Column, some: tuple[str, ...]) -> Column:
        starts = F.sequence(F.lit(0), F.size(form) - len(some))
        here = lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(form, i + k) == t, F.lit(False)) for k, t in enumerate(some)])
        return F.when(F.size(form) >= len(some), F.exists(starts, here)).otherwise(F.lit(False)).cast("int")

    return let(tokens, lambda form: F.array(F.size(F.filter(form, lambda x: x.isNotNull())), *[F.size(F.filter(form, lambda x: x == t)) for t in terms], *[has(form, p) for p in phrases]))  # noqa: B023


def term_counts(docs: DataFrame, text: str, terms: list[str], analyzer: Analyzer = Analyzer()) -> Column:  # noqa: B008
    """How often each of some terms stands in a text, as an array in their order; null for null."""
    return F.slice(facts(F.col(text), analyzer, terms), 2, len(terms))


def phrases_of(node) -> list[Phrase]:
    if isinstance(node, Phrase):
        return [node]
    parts = node.parts if isinstance(node, Or) else (*node.must, *node.should, *node.must_not) if isinstance(node, And) else ()
    return [p for x in parts for p in phrases_of(x)]


def search(docs: DataFrame, node, k: int | None, key: str, text: str, analyzer: Analyzer = Analyzer(), where: Column | None = None, tokens: str | None = None) -> DataFrame:  # noqa: B008
    """Rows of docs with score > 0, the k best first (all, unordered, for None).

    BM25 over all rows with a text; the filter takes away rows, not statistics. Two passes: one aggregates the number of
    documents, their length and each term's document frequency into a single row; the other scores each row by Columns. No row is shuffled but the k best of each partition. `tokens` names a column with the terms, if it is stored.
    """
    node = simplify(node)
    base = docs.where(F.col(text).isNotNull() if tokens is None else F.col(tokens).isNotNull())
    if isinstance(node, Empty) or k == 0:
        return base.withColumn("score", F.lit(0.0)).where(F.lit(False))
    if k is not None and not 0 < k <= MAX_TOPK:
        raise InvalidArgument(f"topk {k}")
    needed, phrases = terms_of(node), list(dict.fromkeys(p.terms for p in phrases_of(node)))
    own = _stored_facts(F.col(tokens), needed, phrases) if tokens else facts(F.col(text), analyzer, needed, phrases)
    stats = base.select(own.alias("f")).agg(
        F.count("*").cast("double").alias("__n"), F.coalesce(F.avg(F.col("f")[0]), F.lit(1.0)).alias("__average"),
        *[F.coalesce(F.sum((F.col("f")[i] > 0).cast("int")), F.lit(0)).cast("double").alias(f"__df{i}") for i in range(1, len(needed) + 1)],
    )
    place = {t: i for i, t in enumerate(needed, 1)}
    rows = (base if where is None else base.where(where)).withColumn("__f", own).crossJoin(F.broadcast(stats))  # one row
    average = F.when(F.col("__average") > 0, F.col("__average")).otherwise(F.lit(1.0))
    tf = lambda t: F.col("__f")[place[t]].cast("double")
    weight = lambda t: idf(F.col("__n"), F.col(f"__df{place[t]}")) * term_weight(tf(t), F.col("__f")[0].cast("double"), average)
    hit, total = points(node, tf, weight, lambda some: F.col("__f")[len(needed) + 1 + phrases.index(some)] > 0)
    out = rows.select(*[c for c in docs.columns if c != "score"], F.when(hit, total).alias("score"))
    if k is None:
        return out.where("score > 0")
    return out.orderBy(F.col("score").desc_nulls_last(), F.col(key)).limit(k).where("score > 0")


def points(node, tf: Callable[[str], Column], weight: Callable[[str], Column], phrase: Callable[[tuple[str, ...]], Column]) -> tuple[Column, Column]:
    """Whether a row matches, and its score if so, from each term's frequency and weight in it, and whether it holds a phrase."""
    if isinstance(node, Term):
        return tf(node.text) > 0, weight(node.text) * node.boost
    if isinstance(node, Phrase):
        there = reduce(lambda a, b: a & b, [tf(t) > 0 for t in sorted(set(node.terms))])
        return F.when(there, phrase(node.terms)).otherwise(F.lit(False)), reduce(lambda a, b: a + b, [weight(t) for t in node.terms]) * node.boost
    parts = lambda nodes: [points(p, tf, weight, phrase) for p in nodes]
    if isinstance(node, Or):
        any_of = parts(node.parts)
        return reduce(lambda a, b: a | b, [m for m, _ in any_of]), _total(any_of) * node.boost
    must, should, never = parts(node.must), parts(node.should), parts(node.must_not)
    return reduce(lambda a, b: a & b, [m for m, _ in must] + [~m for m, _ in never]), _total(must + should) * node.boost


def _total(parts: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(m, s).otherwise(F.lit(0.0)) for m, s in parts])


# --- postings ---------------------------------------------------------------------------------------------------------------------


def postings(docs: DataFrame, key: str, text: str, analyzer: Analyzer = Analyzer(), lengths: bool = False) -> DataFrame:  # noqa: B008
    """term, key, tf, positions, length: one row for each term of each document, and, with lengths, one without a term for each
    document. Terms are counted inside the document, in an Arrow-batched map: no shuffle, and a word that every document holds is no
    group of its own here."""
    each, split = lengths, analyzer.byte_splitter()
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                terms, rows, places, lengths = [], [], [], []
                for row, value in enumerate(part.column(1).to_pylist()):
                    own: dict[bytes, list[int]] = {}
                    for i, t in enumerate(split(value)):
                        if t is not None:
                            own.setdefault(t, []).append(i)
                    terms += own
                    rows += [row] * len(own)
                    places += own.values()
                    total = sum(map(len, own.values()))
                    if each:
                        terms.append(None)
                        rows.append(row)
                        places.append(())
                    lengths += [total] * (len(own) + each)
                tf = pa.array(list(map(len, places)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), part.column(0).take(pa.array(rows, pa.int32())), tf, pa.array(places, pa.list_(pa.int32())), pa.array(lengths, pa.int32())], names=["term", "key", "tf", "positions", "length"])

    return docs.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"term string, key {kind.simpleString()}, tf int, positions array<int>, length int")


def term_stats(p: DataFrame) -> DataFrame:
    """Document frequency, greatest frequency in a document and shortest document of each term, from postings."""
    return p.groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"))


def term_stats_of(docs: DataFrame, text: str, analyzer: Analyzer = Analyzer(), most: int = 200_000) -> DataFrame:  # noqa: B008
    """As term_stats(), from the texts: terms are counted inside the tasks, `most` terms at a time, before they are shuffled."""
    split = analyzer.byte_splitter()
    schema = pa.schema([("term", pa.string()), ("df", pa.int64()), ("max_tf", pa.int32()), ("min_length", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            counts = zip(*held.values(), strict=True) if held else [[]] * 3
            columns = [pa.array(list(held), pa.binary()).cast(pa.string()), *(pa.array(x, f.type) for x, f in zip(counts, list(schema)[1:], strict=True))]
            out = pa.RecordBatch.from_arrays(columns, schema=schema)
            held.clear()
            return out

        for batch in batches:
            for value in batch.column(0).to_pylist():
                own = Counter(split(value))
                own.pop(None, None)
                length = own.total()
                for t, tf in own.items():
                    x = held.get(t)
                    if x is None:
                        held[t] = [1, tf, length]
                    else:
                        x[0] += 1
                        x[1] = max(x[1], tf)
                        x[2] = min(x[2], length)
                if len(held) >= most:
                    yield flush()
        yield flush()

    parts = docs.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "term string, df long, max_tf int, min_length int")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"))


def corpus_stats(docs: DataFrame, text: str, analyzer: Analyzer = Analyzer()) -> DataFrame:  # noqa: B008
    n = F.size(F.filter(analyzer.column(F.col(text)), lambda x: x.isNotNull()))
    return docs.where(F.col(text).isNotNull()).agg(F.count("*").alias("total_docs"), F.coalesce(F.sum(n), F.lit(0)).alias("total_tokens"))


def write_postings(docs: DataFrame, path: str, key: str, text: str, analyzer: Analyzer = Analyzer(), buckets: int = 64) -> None:  # noqa: B008
    """Postings by bucket of the term: a search reads the buckets of its terms only. Adaptive execution splits large buckets and
    joins small ones."""
    p = postings(docs, key, text, analyzer).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    p.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "key").write.mode("overwrite").partitionBy("bucket").parquet(path)


def search_postings(p: DataFrame, terms: list[str], n_docs: int, average: float, k: int, buckets: int = 64) -> DataFrame:
    """key and score of the k best documents that hold any of the terms, from written postings."""
    spark = p.sparkSession
    wanted = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int")).distinct().collect()]
    own = p.where(F.col("bucket").isin(wanted) & F.col("term").isin(terms))
    frequency = own.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    scored = own.join(F.broadcast(frequency), "term").withColumn("w", idf(F.lit(float(n_docs)), F.col("df")) * term_weight(F.col("tf").cast("double"), F.col("length").cast("double"), F.lit(average or 1.0)))
    return scored.groupBy("key").agg(F.sum("w").alias("score")).where("score > 0").orderBy(F.col("score").desc(), "key").limit(k)
