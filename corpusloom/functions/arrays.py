"""Array functions: atoms, packing, framing, masks and offsets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def atoms(word: Column) -> Column:
    """Slices of two characters."""
    n = F.floor(F.length(word) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(word, i * 2 - 1, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def expand_atoms(tokens: Column) -> Column:
    """Encoded tokens as their atoms, other tokens as they are."""
    return F.flatten(F.transform(tokens, lambda t: F.when(t.rlike("^(?:[A-Za-z][0-9])+$"), atoms(t)).otherwise(F.array(t))))


def pack_lines(tokens: Column, most: int) -> Column:
    """Tokens packed greedily into lines of at most `most` characters; a longer token is an error."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("line"))

    def add(s: Column, t: Column) -> Column:
        t = F.when(F.length(t) > most, F.raise_error(F.concat(F.lit("token longer than the limit: "), t)).cast("string")).otherwise(t)
        fits = s["line"].isNotNull() & (F.length(s["line"]) + 1 + F.length(t) <= most)
        new = F.when(s["line"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["line"])))
        return F.when(fits, F.struct(s["done"].alias("done"), F.concat_ws(" ", s["line"], t).alias("line"))).otherwise(F.struct(new.alias("done"), t.alias("line")))

    return F.aggregate(tokens, start, add, lambda s: F.when(s["line"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["line"]))))


def packed(line: Column, tokens: Column, most: int) -> Column:
    """A short line stays as it is, trimmed; a blank one gives none."""
    flat = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    return F.when(flat == "", F.array().cast("array<string>")).when(F.length(flat) <= most, F.array(flat)).otherwise(pack_lines(tokens, most))


def truncate(ids: Column, most: int) -> Column:
    return F.slice(ids, 1, most)


def split_at(ids: Column, u: Column) -> Column:
    """Where a prompt ends: between 30 and 50 per cent of the ids by a uniform draw u, at least 1 and at most n - 1."""
    n = F.size(ids)
    low = F.greatest(F.lit(1), F.floor(n * 0.3).cast("int"))
    high = F.greatest(low, F.floor(n * 0.5).cast("int"))
    return F.least(F.greatest(F.lit(1), low + F.floor(u * (high - low + 1)).cast("int")), n - 1)


def prompt_and_completion(prompt: Column, completion: Column, most: int) -> Column:
    """ids and mask (true over the completion): of the prompt its last `most` - 1 ids, of the completion what still fits."""
    kept = F.when(F.size(prompt) > most - 1, F.slice(prompt, -(most - 1), most - 1)).otherwise(prompt)
    rest = F.slice(completion, F.lit(1), F.greatest(F.lit(0), F.lit(most) - F.size(kept)))
    return F.struct(F.concat(kept, rest).alias("ids"), F.concat(F.array_repeat(F.lit(False), F.size(kept)), F.array_repeat(F.lit(True), F.size(rest))).alias("mask"))


def pad(items: Column, filler: Column, length: Column) -> Column:
    return F.concat(items, F.array_repeat(filler, F.greatest(F.lit(0), length - F.size(items))))


def attention(ids: Column, length: Column) -> Column:
    return pad(F.transform(ids, lambda x: F.lit(1)), F.lit(0), length)


def masked_labels(labels: Column, mask: Column) -> Column:
    return F.zip_with(labels, mask, lambda x, m: F.when(m == 0, -100).otherwise(x))


def valid_ids(ids: Column) -> Column:
    return ids.isNull() | F.forall(ids, lambda x: x.isNotNull() & (x >= 0))


def joined(tokens: Column, readable: bool = False) -> Column:
    """Tokens joined by spaces, with none between neighbouring atoms unless readable."""
    return F.array_join(tokens, " ") if readable else joined_atoms(tokens)


def joined_atoms(tokens: Column) -> Column:
    """Runs of atoms written together, other tokens apart."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("atom"))

    def add(s: Column, t: Column) -> Column:
        atom = t.rlike("^[A-Za-z][0-9]$")
        gap = F.when((s["text"] == "") | (s["atom"] & atom), "").otherwise(" ")
        return F.struct(F.concat(s["text"], gap, t).alias("text"), atom.alias("atom"))

    return F.aggregate(tokens, start, add, lambda s: s["text"])


def framed(ids: Column, bos: int | None, eos: int | None, pair: Column | None = None) -> Column:
    """ids with optional start and end ids, for a pair around each, and the mask of what was added."""
    one, zero = F.lit(1), lambda x: F.transform(x, lambda _: F.lit(0))
    parts, mask = [], []
    for x in (ids,) if pair is None else (ids, pair):
        parts += [F.array(F.lit(bos))] * (bos is not None) + [x] + [F.array(F.lit(eos))] * (eos is not None)
        mask += [F.array(one)] * (bos is not None) + [zero(x)] + [F.array(one)] * (eos is not None)
    return F.struct(F.concat(*parts).alias("ids"), F.concat(*mask).alias("special"))


def spread_offsets(n: Column, length: Column) -> Column:
    """Spans of n tokens spread evenly over a text of a length."""
    at, many, length = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.greatest(n, F.lit(1)), length.cast("long")
    spans = F.transform(at, lambda i: F.struct(F.floor(i * length / many).cast("int").alias("start"), F.ceil((i + 1) * length / many).cast("int").alias("end")))
    return F.when(n > 0, spans).otherwise(F.slice(spans, 1, 0))
