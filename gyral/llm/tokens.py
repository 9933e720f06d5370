"""Byte-level BPE with a public vocabulary as Spark higher-order functions."""

from __future__ import annotations

import base64
import json
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the rank file lies; a parameter of every function here.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text into words (fixed value); \s as Unicode white space.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A token is written as the character FIRST + id, so that a word is a string and a merge a replacement in it.
FIRST = 0x100
BUCKETS = 16_384
#: Words of more bytes are cut, before they are folded, where no piece of the vocabulary can reach across.
UNCUT = 48
#: Most frequent words that are looked up instead of folded anew, and their longest length: only speed depends on it.
DICTIONARY, LONGEST = 32_768, 48


@cache
def load_ranks(path: str) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Pieces by id, and for each piece of two or more bytes the two ids whose merge makes it, in rank order."""
    pieces = [b""] * sum(1 for _ in open(path, "rb"))
    for line in open(path, "rb"):
        piece, rank = line.split()
        pieces[int(rank)] = base64.b64decode(piece)
    number = {p: i for i, p in enumerate(pieces)}
    pairs = []
    for i, piece in enumerate(pieces):
        if len(piece) > 1:  # merging its bytes with earlier ranks only leaves its two parts
            parts = [piece[k : k + 1] for k in range(len(piece))]
            while len(parts) > 2:
                best = min((number.get(a + b, i), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            pairs.append((number[parts[0]], number[parts[1]]))
    return pieces, pairs


def _literal(value: object, kind: str) -> Column:
    """A folded constant: the optimizer parses the text once per plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


@cache
def _tables(path: str) -> tuple[str, list, list]:
    pieces, pairs = load_ranks(path)
    base = len(pieces) - len(pairs)
    by_byte = {p[0]: chr(FIRST + i) for i, p in enumerate(pieces) if len(p) == 1}
    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    for rank, (a, b) in enumerate(pairs):
        buckets[((FIRST + a) * 31 + FIRST + b) % BUCKETS][chr(FIRST + a) + chr(FIRST + b)] = chr(FIRST + base + rank)
    return "".join(by_byte[b] for b in range(256)), buckets, [chr(FIRST + a) + chr(FIRST + b) for a, b in pairs]


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))


@cache
def _joined(path: str) -> list[list[bool]]:
    """[a][b]: whether some piece holds byte b right after byte a."""
    table = [[False] * 256 for _ in range(256)]
    for piece in load_ranks(path)[0]:
        for a, b in zip(piece, piece[1:]):
            table[a][b] = True
    return table


def _parts(raw: Column, path: str) -> Column:
    """A word, a character a byte, cut wherever no piece holds the bytes on both sides: no merge can reach across."""
    joined = _literal(_joined(path), "array<array<boolean>>")
    after = lambda c, n: F.when(F.element_at(F.element_at(joined, F.ascii(c) + 1), F.ascii(n) + 1), c).otherwise(F.concat(c, F.lit(chr(FIRST))))
    marked = _let(F.split(raw, ""), lambda c: F.concat(F.array_join(F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), after), ""), F.element_at(c, -1)))
    return F.when(F.length(raw) > UNCUT, F.split(marked, chr(FIRST))).otherwise(F.array(raw))


def fold_merges(word: Column, path: str = RANKS) -> Column:
    """ids of one word: its bytes folded by the lowest-ranked merge that is left, all its places at once, until none is.

    A step looks at all that is left of a part, and a part takes as many steps as it has different merges: long words are
    therefore cut first where the vocabulary allows, every few bytes in words of random letters.
    """
    letters, buckets, pairs = _tables(path)
    ranks, parts = _literal(buckets, "array<map<string,string>>"), _literal(pairs, "array<string>")
    base = len(load_ranks(path)[0]) - len(pairs)

    def rank(a: Column, b: Column) -> Column:
        bucket = F.element_at(ranks, (F.pmod(F.ascii(a) * 31 + F.ascii(b), F.lit(BUCKETS)) + 1).cast("int"))
        return F.try_element_at(bucket, F.concat(a, b))

    def step(state: Column, _: Column) -> Column:
        now = state["w"]
        lowest = _let(F.split(now, ""), lambda c: F.array_min(F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), rank)))
        merged = _let(
            lowest,
            lambda m: F.when(m.isNull(), F.struct(now.alias("w"), F.lit(False).alias("live"))).otherwise(
                F.struct(F.replace(now, F.element_at(parts, F.ascii(m) - (FIRST + base) + 1), m).alias("w"), F.lit(True).alias("live"))
            ),
        )
        return F.when(state["live"] & (F.length(now) > 1), merged).otherwise(F.struct(now.alias("w"), F.lit(False).alias("live")))

    def fold(part: Column) -> Column:
        start = F.translate(part, "".join(map(chr, range(256))), letters)
        done = _let(start, lambda w: F.when(F.length(w) < 2, w).otherwise(F.aggregate(F.sequence(F.lit(1), F.length(w) - 1), F.struct(w.alias("w"), F.lit(True).alias("live")), step)["w"]))
        return F.transform(F.split(done, ""), lambda c: F.ascii(c) - FIRST)

    return _let(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), lambda raw: F.flatten(F.transform(_parts(raw, path), fold)))


def _spot(word: Column) -> Column:
    """The bucket of a word in the dictionary."""
    return F.pmod(F.hash(word), F.lit(BUCKETS))


def dictionary(docs: DataFrame, text: str, path: str = RANKS) -> list:
    """(spot, word, ids) of the most frequent short words, counted over all texts; at most DICTIONARY."""
    each = docs.select(F.explode(words(F.col(text))).alias("word")).filter(F.length("word") <= LONGEST)
    often = each.groupBy("word").count().filter("count > 1").orderBy(F.desc("count"), "word").limit(DICTIONARY)
    return often.repartition(docs.sparkSession.sparkContext.defaultParallelism).select(_spot(F.col("word")).alias("spot"), "word", fold_merges(F.col("word"), path).alias("ids")).collect()


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str = RANKS) -> DataFrame:
    """docs with `out`, the ids of `text` as the tokenizer gives them without special tokens, and all other columns.

    Null and empty texts have the empty list; markers of special tokens in a text are ordinary text. Frequent
    words are encoded once and looked up in a bounded constant, all others are folded where they stand: no row is
    shuffled, and the length of a text bounds a task's work. `out` replaces a column of that name.
    """
    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    for spot, word, ids in dictionary(docs, text, path):
        buckets[spot][word] = ids
    known = _literal(buckets, "array<map<string,array<int>>>")

    def ids_of(word: Column) -> Column:
        return F.coalesce(F.try_element_at(F.element_at(known, _spot(word) + 1), word), fold_merges(word, path))

    return docs.withColumn(out, F.flatten(F.transform(words(F.col(text)), ids_of)))


def decode_ids(ids: Column, path: str = RANKS) -> Column:
    """The text of a list of ids: its binary pieces in a row, read as UTF-8; null for null."""
    pieces = _literal([p.hex() for p in load_ranks(path)[0]], "array<string>")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(pieces, i + 1)), "")), "UTF-8")
