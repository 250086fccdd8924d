"""Hanzi to codes, by a caller's table of readings.

Each character is a word of its own (there is no dictionary of words), and its reading comes from a table
(character, syllable), the syllable with a digit for its tone. There are no more codes than Hanzi, so their table is broadcast, and
texts are encoded row by row: what becomes nothing is blanked before they are lexed, so that a token's place is its position.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .counting import items

#: What one syllable becomes in each mode; the reading of tones is for display.
MODES = {"pinyin-code": T.syllable_atom, "pinyin-initial": T.syllable_initial, "hanzi": None, "tone-marks": T.tone_marked}
#: All Hanzi in one string.
EVERY = "".join(chr(c) for first, last in re.findall("(.)-(.)", T.HANZI) for c in range(ord(first), ord(last) + 1))


def _check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {tuple(MODES)}")


def character_codes(readings: DataFrame, mode: str = "pinyin-code") -> DataFrame:
    """character, code: what each of the Hanzi becomes that has a reading. Of several readings the least one counts; empty codes are left out."""
    one = readings.where(F.col("character").rlike(f"^[{T.HANZI}]\\z")).groupBy("character").agg(F.min("syllable").alias("syllable"))
    return one.select("character", MODES[mode](F.col("syllable")).alias("code")).where("code <> ''")


def run_codes(runs: DataFrame, readings: DataFrame, mode: str = "pinyin-code") -> DataFrame:
    """run, codes: an array with what each character of a run becomes, in order. runs: different runs of Hanzi in a column run.

    Characters without a reading are left out, as are empty codes; of several readings of a character the least one counts.
    """
    _check_mode(mode)
    parts = runs.select("run", F.posexplode(F.split("run", "")).alias("n", "character"))
    coded = parts.join(character_codes(readings, mode), "character") if MODES[mode] else parts.withColumn("code", F.col("character"))
    in_order = F.sort_array(F.collect_list(F.struct("n", "code")))
    return coded.groupBy("run").agg(F.transform(in_order, lambda x: x["code"]).alias("codes"))


def encode(df: DataFrame, readings: DataFrame, text: str = "text", key: str = "doc_id", mode: str = "pinyin-code", normal: bool = True) -> DataFrame:
    """key, pos, item: the routed tokens of each text with runs of Hanzi as their codes; pos counts from 0 without gaps.

    normal: texts are normalised first. key tells rows apart.
    """
    _check_mode(mode)
    given = T.normalize(F.col(text)) if normal else F.col(text)
    if MODES[mode]:
        codes = character_codes(readings, mode).select(F.col("character").alias("_character"), F.col("code").alias("_code"))
        every = df.sparkSession.range(1).select(F.explode(F.split(F.lit(EVERY), "")).alias("_character"))
        silent = every.join(codes, "_character", "left_anti").agg(F.array_join(F.sort_array(F.collect_list("_character")), ""))
        given = F.call_function("translate", given, silent.scalar(), F.lit(" " * len(EVERY)))
    tokens = items(df.select(key, T.blank_dropped(given).alias("_kept")), T.lex(F.col("_kept"), single=True), key)
    token = F.col("item")
    if not MODES[mode]:
        return tokens.select(key, "pos", T.route_lexed(token).alias("item"))
    # ASCII is not looked up
    coded = tokens.join(F.broadcast(codes), F.when(token > "~", token) == codes["_character"], "left")
    return coded.select(key, "pos", F.coalesce("_code", T.route_lexed(token)).alias("item"))


def encode_once(df: DataFrame, readings: DataFrame, text: str = "text", key: str = "doc_id", mode: str = "pinyin-code") -> DataFrame:
    """key, pos, item: texts that hold Hanzi, or don't look encoded, are encoded; the others are cut at white space as they stand."""
    raw: Column = T.has_hanzi(F.col(text)) | ~T.looks_preprocessed(F.col(text), codes=mode == "pinyin-code")
    as_is = items(df.where(~raw), T.words(F.col(text)), key)
    return encode(df.where(raw), readings, text, key, mode).unionByName(as_is)


def syllable_cases(df: DataFrame, readings: DataFrame, text: str = "text") -> DataFrame:
    """character, syllable of all Hanzi of the texts that have a reading, each once."""
    spans = df.select(F.explode(T.hanzi_spans(F.col(text))).alias("run")).distinct()
    characters = spans.select(F.explode(F.split("run", "")).alias("character")).distinct()
    return characters.join(readings, "character").select("character", "syllable").distinct()
