"""Token-level expressions: tokenise, classify, templates, skeletons.  Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import NUMBER_DIGITS

#: A run of neither white space nor pipe, one white-space character, or a pipe (fixed values of the data model, as are the next).
TOKEN = r"(?U)[^\s|]+|\s|\|"
WORD = r"[\p{L}\p{N}]+"
HOLE = "<>"
#: A whole token that varies: with a digit, a slash or a drive, and with an ASCII letter or digit.
VARIABLE = r"(?U)(?<![^\s|])(?=[^\s|]*[A-Za-z0-9])[^\s|]*?(?:[/\d]|[a-zA-Z]:\\)[^\s|]*"


def tokens(line: Column) -> Column:
    """All tokens of a line; joined, they are the line."""
    return F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0))


def is_path(tok: Column) -> Column:
    return F.contains(tok, F.lit("/")) | tok.rlike(r"[a-zA-Z]:\\")


def has_digit(tok: Column) -> Column:
    return tok.rlike(r"(?U)\d")


def is_numeric(tok: Column) -> Column:
    return tok.rlike(r"^[0-9]+$")


def is_variable(tok: Column) -> Column:
    return tok.rlike(VARIABLE)


def is_short_number(tok: Column) -> Column:
    return tok.rlike(f"^[0-9]{{1,{NUMBER_DIGITS}}}$")


def is_string(tok: Column) -> Column:
    """Whether a token that varies and is no number is kept as a dictionary string.

    A mixed token that has the hole's characters itself is one: its skeleton would be ambiguous.
    """
    return tok.rlike(r"^[A-Za-z0-9]+$") | F.contains(tok, F.lit(HOLE))


def variable_class(tok: Column) -> Column:
    """'num' (up to 15 digits), 'str' (dictionary string) or 'comp' (letters or digits mixed with others)."""
    return F.when(is_short_number(tok), F.lit("num")).when(is_string(tok), F.lit("str")).otherwise(F.lit("comp"))


def token_class(tok: Column) -> Column:
    """'lit', or the class of a token that varies.  One pattern tells most tokens, the literals."""
    return F.when(~is_variable(tok), F.lit("lit")).otherwise(variable_class(tok))


def placeholder(tok: Column) -> Column:
    """The token as a template shows it: literals as they are, numbers by length, strings and composites by a mark."""
    number = F.concat(F.lit("<"), F.char(F.length(tok) + 96), F.lit(">"))
    return F.when(~is_variable(tok), tok).when(is_short_number(tok), number).when(is_string(tok), F.lit("<*>")).otherwise(F.lit("<->"))


def template(toks: Column) -> Column:
    return F.array_join(F.transform(toks, placeholder), "")


def variables(toks: Column) -> Column:
    """Array of (pos, cls, tok) of the tokens that are no literals."""
    placed = F.filter(F.transform(toks, lambda t, i: F.struct(i.alias("pos"), t.alias("tok"))), lambda s: is_variable(s["tok"]))
    return F.transform(placed, lambda s: F.struct(s["pos"].alias("pos"), variable_class(s["tok"]).alias("cls"), s["tok"].alias("tok")))


def line_variables(line: Column) -> Column:
    """The tokens of a whole line that are no literals, found in one pass over it."""
    return F.regexp_extract_all(line, F.lit(VARIABLE), F.lit(0))


def line_literals(line: Column) -> Column:
    """What stands between them: one more piece than there are variables."""
    return F.split(line, VARIABLE, -1)


def shape(toks: Column) -> Column:
    """Array of (cls, text): the template out of band, with text only for literals."""
    return F.transform(toks, lambda t: F.struct(token_class(t).alias("cls"), F.when(~is_variable(t), t).alias("text")))


def skeleton(tok: Column) -> Column:
    return F.regexp_replace(tok, WORD, HOLE)


def sub_words(tok: Column) -> Column:
    return F.regexp_extract_all(tok, F.lit(WORD), F.lit(0))


def literals(tok: Column) -> Column:
    """What stands between the sub-words: one more piece than there are sub-words."""
    return F.split(tok, WORD, -1)


def fill(lits: Column, words: Column) -> Column:
    """Literals and words interleaved; a null word shows as a hole."""
    shown = F.transform(words, lambda w: F.coalesce(w, F.lit(HOLE)))
    pairs = F.zip_with(F.slice(lits, 1, F.size(lits) - 1), shown, lambda a, b: F.concat(a, b))
    return F.concat(F.array_join(pairs, ""), F.element_at(lits, -1))


def key_of_length(n: Column) -> Column:
    return F.char(n + 96)


def length_of_key(key: Column) -> Column:
    return F.ascii(key) - 96
