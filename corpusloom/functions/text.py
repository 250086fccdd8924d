"""Text functions: normalisation, lexing, routing and syllable codes, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LABELS = {"题干": "<QUESTION>", "选项": "<OPTIONS>", "答案": "<ANSWER>", "解析": "<EXPLANATION>"}
PUNCTUATION = "。，、？！：；.,?!:;()[]{}<>《》【】“”\"'‘’「」『』—-~…/\\"
SPECIAL_TOKENS = ["<QUESTION>", "<OPTIONS>", "<ANSWER>", "<EXPLANATION>", "<MATH>", "<URL>", "<BLANK>", "<YES>", "<NO>", "<NUM>"]
LATIN = "A-Za-zÀ-ÖØ-öø-ÿĀ-ſƀ-ɏɐ-ʯ"
HANZI = "㐀-䶿一-鿿"
LATIN_WORD = f"(?:[{LATIN}][{LATIN}0-9]*(?:[-_][{LATIN}0-9]+)*|[0-9]+[{LATIN}][{LATIN}0-9]*(?:[-_][{LATIN}0-9]+)*)"
ENCODED_WORD = "(?:[A-Za-z][0-9])+"
MARKER = "<[A-Z_]+>"
TOKEN = f"(?U)({MARKER}|[{HANZI}]+|{LATIN_WORD}|\\S)"
MALFORMED = "[�⁇]"
TONE_MARKS = ["\u0304", "\u0301", "\u030c", "\u0300"]
URL = r"(?iuU)\b(?:https?://\S*|www\.\S+)"
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
# By rule: digits as the isdigit of Python strings has them, the decimal ones and those of other kinds such as superscripts.
OTHER_DIGITS = "".join(c for c in map(chr, range(0x20000)) if c.isdigit() and unicodedata.category(c) != "Nd")
NUMBER = f"[\\p{{Nd}}{OTHER_DIGITS}]+"
# What route drops. Java tries a class from its last part inwards, so the many digits stand apart.
DROPPED = f"(?U)[�[^ -~{HANZI}\\p{{L}}\\p{{P}}\\p{{S}}\\p{{Nd}}\\s]](?<![{OTHER_DIGITS}])"


def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """NFKC, which Spark has no function for; plain ASCII never leaves the JVM's own expressions."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.pandas_udf(_nfkc, "string")(text)).otherwise(text)


def mark_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, " <URL> ")


def mark_math(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\$\$.*?\$\$", " <MATH> ")


def mark_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[（(]\s*[）)]", " <BLANK> ")


def mark_labels(text: Column) -> Column:
    for label, marker in LABELS.items():
        text = F.regexp_replace(text, f"(?U){label}\\s*[:：]", f" {marker} ")
    return text


def mark_answers(text: Column) -> Column:
    for word, marker in (("yes", "<YES>"), ("no", "<NO>")):
        text = F.regexp_replace(text, f"(?iu)(?<![{LATIN}]){word}(?![{LATIN}])", f" {marker} ")
    return text


def space_options(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)(?<![{LATIN}])[ABCD](?=\\s*[:：.．、\\)])", " $0 ")


def mark_numbers(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)(?<![{LATIN}0-9])[-+]?\\d+(?:[.,]\\d+)*(?:%|％)?(?![{LATIN}0-9])", " <NUM> ")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


#: The steps in their order, which is part of the meaning.
STEPS = {
    "nfkc": nfkc, "urls": mark_urls, "math": mark_math, "blanks": mark_blanks, "labels": mark_labels, "answers": mark_answers,
    "options": space_options, "numbers": mark_numbers, "parentheses": lambda x: F.translate(x, "（）", "()"), "spaces": collapse_spaces,
}


def normalize(text: Column, *steps: str) -> Column:
    """All steps, or only those named, always in the fixed order."""
    for name, step in STEPS.items():
        if not steps or name in steps:
            text = step(text)
    return text


def lex(text: Column, single: bool = False) -> Column:
    """The tokens of a text; single: each of the Hanzi is a token of its own."""
    return F.regexp_extract_all(text, F.lit(TOKEN.replace(f"[{HANZI}]+", f"[{HANZI}]") if single else TOKEN), F.lit(1))


def blank_dropped(text: Column) -> Column:
    """The text with spaces for all characters that route drops. They are tokens by themselves, so the others stay the same."""
    return F.regexp_replace(text, DROPPED, " ")


def is_latin_word(token: Column) -> Column:
    return token.rlike(f"^{LATIN_WORD}$")


def is_punctuation(token: Column) -> Column:
    return token.isin(*PUNCTUATION)


def is_hanzi(token: Column) -> Column:
    return token.rlike(f"^[{HANZI}]+$")


def has_hanzi(text: Column) -> Column:
    return text.rlike(f"[{HANZI}]")


def is_visible(token: Column) -> Column:
    """Letters, punctuation and symbols only, and not the replacement character."""
    return (token != "�") & token.rlike(r"^[\p{L}\p{P}\p{S}]*$")


def is_encoded(token: Column) -> Column:
    return token.rlike(f"^{ENCODED_WORD}$")


def is_atom(token: Column) -> Column:
    return token.rlike("^[A-Za-z][0-9]$")


def atom_count(token: Column) -> Column:
    return F.floor(F.length(token) / 2).cast("int")


def latin_case(token: Column) -> Column:
    return F.when((F.length(token) == 1) & F.upper(token).isin("A", "B", "C", "D"), F.upper(token)).otherwise(F.lower(token))


def route(token: Column, hanzi: Column | None = None) -> Column:
    """What a lexed token becomes; null drops it. hanzi: what a run of Hanzi becomes, itself if not given.

    The kinds share no token, so their order is free; the commonest one is tested first.
    """
    return (
        F.when(token.startswith("<") & token.endswith(">") & (F.length(token) > 1), token)
        .when(is_latin_word(token), latin_case(token))
        .when(is_punctuation(token), token)
        .when(is_hanzi(token), token if hanzi is None else hanzi)
        .when(token.rlike(f"^{NUMBER}$"), "<NUM>")
        .when(is_visible(token), F.lower(token))
    )


def route_lexed(token: Column) -> Column:
    """route of a token that lex made with single: one of several characters is a marker or a Latin word. The commonest kinds need no pattern."""
    several = F.when(token.startswith("<"), token).otherwise(F.lower(token))
    return F.when(F.length(token) > 1, several).when(token.between("e", "z") | is_punctuation(token), token).otherwise(route(token))


def process(text: Column) -> Column:
    """Normalised, lexed and routed tokens of a text."""
    return F.filter(F.transform(lex(normalize(text)), lambda t: route(t)), lambda x: x.isNotNull())


def item_class(item: Column) -> Column:
    """special, encoded, preserved or invalid, the first that fits."""
    return F.when(item.isin(*SPECIAL_TOKENS), "special").when(is_encoded(item), "encoded").when(is_punctuation(item) | is_latin_word(item) | is_visible(item), "preserved").otherwise("invalid")


def words(text: Column) -> Column:
    """Pieces between Unicode white space, none of them empty."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), F.lit(1))


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def hanzi_spans(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"([{HANZI}]+)"), F.lit(1))


def looks_preprocessed(text: Column, codes: bool = True) -> Column:
    """Whether a text holds a marker or, with codes, an encoded word that stands alone."""
    found = text.rlike(MARKER)
    return found | text.rlike(f"(?<![A-Za-z0-9]){ENCODED_WORD}(?![A-Za-z0-9])") if codes else found


def preprocess_once(text: Column, codes: bool = True) -> Column:
    """Encodes raw text and leaves what is encoded already."""
    encoded = F.array_join(process(text), " ")
    return F.when(has_hanzi(text), encoded).when(looks_preprocessed(text, codes), text).otherwise(encoded)


def clip(text: Column, most: int = 180) -> Column:
    flat = collapse_spaces(text)
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def latex(text: Column) -> Column:
    """Each special character escaped once, in one pass over the characters."""
    table = F.create_map(*[F.lit(x) for pair in LATEX.items() for x in pair])
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(table[c], c)), "")


def syllable_plain(syllable: Column) -> Column:
    low = F.lower(syllable)
    return F.when(low.rlike("^[a-züv]+[1-5]?$"), F.regexp_extract(low, "^([a-züv]+)", 1)).otherwise(syllable)


def syllable_tone(syllable: Column) -> Column:
    low = F.lower(syllable)
    return F.when(low.rlike("^[a-züv]+[1-5]$"), F.substring(low, -1, 1).cast("int")).otherwise(5)


def syllable_atom(syllable: Column) -> Column:
    """Initial and digit: case and the upper half of the digits give the tone, the rest of the digit the length."""
    plain, tone = syllable_plain(syllable), syllable_tone(syllable)
    digit = F.when(tone >= 3, 5).otherwise(0) + F.least(F.greatest(F.length(plain), F.lit(1)), F.lit(5)) - 1
    first = F.substring(plain, 1, 1)
    return F.when(plain == "", "").otherwise(F.concat(F.when(tone.isin(1, 3, 5), F.upper(first)).otherwise(F.lower(first)), digit.cast("string")))


def syllable_initial(syllable: Column) -> Column:
    return F.lower(F.substring(syllable_plain(syllable), 1, 1))


def tone_marked(syllable: Column) -> Column:
    """The syllable with a mark on the vowel that carries its tone: a or e if there is one, the o of ou, else the last vowel."""
    plain, tone = syllable_plain(syllable), syllable_tone(syllable)
    at = F.when(plain.contains("a"), F.instr(plain, "a")).when(plain.contains("e"), F.instr(plain, "e")).when(plain.contains("ou"), F.instr(plain, "o"))
    at = F.coalesce(at, F.length(F.regexp_extract(plain, "^(.*[iouüv])", 1)))
    mark = F.element_at(F.array(*(F.lit(m) for m in TONE_MARKS)), F.least(tone, F.lit(4)))
    vowel = F.when(F.substring(plain, at, F.lit(1)) == "v", "ü").otherwise(F.substring(plain, at, F.lit(1)))
    made = F.concat(F.substring(plain, F.lit(1), at - 1), vowel, mark, F.substring(plain, at + 1, F.length(plain)))
    return F.when((tone == 5) | (at == 0), plain).otherwise(made)


def word_code(syllables: Column, mode: str = "pinyin-code") -> Column:
    """The code of a word from its array of syllables."""
    one = {"pinyin-code": syllable_atom, "pinyin-initial": syllable_initial}[mode]
    return F.array_join(F.transform(syllables, one), "")


def case_tone(syllable: Column) -> Column:
    return F.when(syllable.rlike("[1-4]$"), F.substring(syllable, -1, 1)).otherwise("blank")


def case_length(syllable: Column) -> Column:
    return F.length(F.regexp_replace(syllable, "[1-4]$", ""))


def tone_bucket(tone: Column) -> Column:
    return F.when(tone.isin("1", "2", "4"), F.concat(F.lit("tone_"), tone)).when(tone.isin("3", "5", "blank"), "tone_3_or_5").otherwise(F.raise_error(F.concat(F.lit("unsupported tone: "), tone)))


def length_bucket(length: Column) -> Column:
    return (
        F.when(length.isin(1, 2), "length_1_or_2").when(length == 3, "length_3").when(length.isin(4, 5, 6), "length_4_to_6")
        .otherwise(F.raise_error(F.concat(F.lit("unsupported length: "), length.cast("string"))))
    )
