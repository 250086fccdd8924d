"""The tokenizer as callers use it: texts, pairs and batches in, ids with masks and offsets out.

A tokenizer is a vocabulary table and settings. Raw texts are encoded once (texts that look encoded stay as they are),
encoded words are segmented by longest match or by seeded draws, and the ids of a row are put together again in order.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from . import hanzi, vocabulary
from .counting import items

# The ids that the fixed tokens have.
PAD, UNK, BOS, EOS = 0, 1, 2, 3


@dataclass(frozen=True)
class Tokenizer:
    """vocabulary: token, token_id, score. readings: (character, syllable), for Hanzi; without it runs of Hanzi stay as they are."""

    vocabulary: DataFrame
    readings: DataFrame | None = None
    mode: str = "greedy"
    alpha: float = 1.0
    beta: float = 1.0
    temperature: float = 1.0
    epsilon: float = 1e-8
    seed: int = 0
    strict: bool = False
    add_bos: bool = False
    add_eos: bool = False
    readable: bool = False

    def __post_init__(self):
        object.__setattr__(self, "mode", vocabulary.check_parameters(self.mode, self.alpha, self.beta, self.temperature, self.epsilon))

    def using(self, **settings) -> Tokenizer:
        """The same tokenizer with other settings (mode, temperature, seed, ...); this one keeps its own."""
        return replace(self, **settings)

    def size(self) -> int:
        return self.vocabulary.count()

    def items(self, df: DataFrame, text: str = "text", key: str = "doc_id", raw: bool = True) -> DataFrame:
        """key, pos, item of each text. raw: texts may be raw and are encoded once; else they are cut at white space."""
        if not raw:
            return items(df, T.words(F.col(text)), key)
        if self.readings is not None:
            return hanzi.encode_once(df, self.readings, text, key)
        return items(df.withColumn("_once", T.preprocess_once(F.col(text))), T.words(F.col("_once")), key)

    def tokens(self, df: DataFrame, text: str = "text", key: str = "doc_id", raw: bool = True) -> DataFrame:
        """key, tokens: the pieces of each text in order; a null or blank text has none."""
        rows = self.items(df, text, key, raw)
        made = vocabulary.tokenize_items(rows, self.vocabulary, self.strict, self.mode, key, self.seed, self.alpha, self.beta, self.temperature, self.epsilon)
        in_order = F.sort_array(F.collect_list(F.struct("pos", "pieces")))
        whole = made.groupBy(F.col(key).alias("_key")).agg(F.flatten(F.transform(in_order, lambda x: x["pieces"])).alias("tokens"))
        keys = df.select(key)
        return keys.join(whole, keys[key].eqNullSafe(whole["_key"]), "left").select(key, F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))

    def ids(self, df: DataFrame, text: str = "text", key: str = "doc_id", raw: bool = True, stored: str | None = None) -> DataFrame:
        """key, ids; stored: a column of ids that, where it is not null, stands instead of the text's."""
        rows = self.tokens(df, text, key, raw).select(key, F.posexplode_outer("tokens").alias("pos", "item"))
        found = vocabulary.to_ids(rows, self.vocabulary, UNK)
        in_order = F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "token_id"))))
        made = found.groupBy(key).agg(F.transform(in_order, lambda x: x["token_id"]).alias("ids"))
        if stored is None:
            return made
        kept = df.select(F.col(key).alias("_key"), F.col(stored).alias("_stored"))
        return made.join(kept, made[key].eqNullSafe(kept["_key"])).select(key, F.coalesce(F.col("_stored").cast("array<int>"), "ids").alias("ids"))

    def encode(self, df: DataFrame, text: str = "text", pair: str | None = None, key: str = "doc_id", raw: bool = True, special: bool = True, most: int | None = None) -> DataFrame:
        """key, input_ids, special_tokens_mask, token_type_ids, attention_mask and offsets of each row's text, or text and pair.

        special: start and end ids are added as the settings say. Offsets spread a text's tokens evenly over it; added ids have (0, 0).
        most: so many ids are kept.
        """
        sides = [self.ids(df, s, key, raw).select(F.col(key).alias(f"_k{n}"), F.col("ids").alias(f"ids{n}")) for n, s in enumerate([text, *([pair] if pair else [])])]
        size = lambda s: F.coalesce(F.length(s), F.lit(0))
        rows = df.select(key, *(size(s).alias(f"length{n}") for n, s in enumerate([text, *([pair] if pair else [])])))
        rows = reduce(lambda d, x: d.join(x[1], d[key].eqNullSafe(x[1][f"_k{x[0]}"])), enumerate(sides), rows)
        bos, eos = (BOS if special and self.add_bos else None), (EOS if special and self.add_eos else None)
        framed = A.framed(F.col("ids0"), bos, eos, F.col("ids1") if pair else None)
        nowhere = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
        spans: list[Column] = []
        for n in range(len(sides)):
            spans += [F.array(nowhere)] * (bos is not None) + [A.spread_offsets(F.size(f"ids{n}"), F.col(f"length{n}"))] + [F.array(nowhere)] * (eos is not None)
        cut = (lambda x: A.truncate(x, most)) if most is not None else (lambda x: x)
        return rows.select(
            key, cut(framed["ids"]).alias("input_ids"), cut(framed["special"]).alias("special_tokens_mask"), cut(F.transform(framed["ids"], lambda _: F.lit(0))).alias("token_type_ids"),
            cut(F.transform(framed["ids"], lambda _: F.lit(1))).alias("attention_mask"), cut(F.concat(*spans)).alias("offsets"),
        )

    def inspect(self, df: DataFrame, n: int = 5, text: str = "text", key: str = "doc_id", raw: bool = True) -> DataFrame:
        """key, text, tokens and ids of the first n rows."""
        few = df.select(key, text).orderBy(key).limit(n)
        tokens = self.tokens(few, text, key, raw).withColumnRenamed(key, "_k")
        ids = self.ids(few, text, key, raw).withColumnRenamed(key, "_j")
        joined = few.join(tokens, few[key].eqNullSafe(tokens["_k"])).join(ids, few[key].eqNullSafe(ids["_j"]))
        return joined.select(key, text, "tokens", "ids").orderBy(key)

    def decode(self, df: DataFrame, ids: str = "ids", key: str = "doc_id", skip_special: bool = True) -> DataFrame:
        """key, text: tokens joined again, neighbouring atoms without a space unless readable."""
        rows = vocabulary.to_tokens(df.select(key, F.posexplode_outer(ids).alias("pos", "token_id")), self.vocabulary)
        if skip_special:
            rows = rows.withColumn("item", F.when(~F.col("item").isin(vocabulary.FIXED_TOKENS), F.col("item")))
        in_order = F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull() & F.col("item").isNotNull(), F.struct("pos", "item"))))
        made = rows.groupBy(key).agg(F.transform(in_order, lambda x: x["item"]).alias("tokens"))
        return made.select(key, A.joined(F.col("tokens"), self.readable).alias("text"))
