"""Tokens, stop words and prompts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two or more word characters. Java's plain \w is ASCII only, hence the classes.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Spark ML's default English stop words. Pass another list to
# change them; contractions never match a token but belong to the list.
ENGLISH_STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him
    his himself she her hers herself it its itself they them their theirs themselves
    what which who whom this that these those am is are was were be been being have
    has had having do does did doing a an the and but if or because as until while of
    at by for with about against between into through during before after above below
    to from up down in out on off over under again further then once here there when
    where why how all any both each few more most other some such no nor not only own
    same so than too very s t can will just don should now i'll you'll he'll she'll
    we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
    they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't
    don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot
    could here's how's let's ought that's there's what's when's where's who's why's
    would
    """.split()
)

# Fixed value: the zero-shot question, with the comment in its place.
ZERO_SHOT_PROMPT = 'Comment: "%s"\nIs this comment toxic? Answer:'


def tokenize(text: Column) -> Column:
    """Lower-cased runs of two or more word characters, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def without_stop_words(tokens: Column, stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> Column:
    words = list(stop_words)
    return F.filter(tokens, lambda t: ~t.isin(*words)) if words else tokens


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def tokens_sql(column: str, stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> str:
    """:func:`tokenize` and :func:`without_stop_words` of a text column as SQL, for stages
    that are saved as text; null has no tokens."""
    tokens = f"regexp_extract_all(lower(coalesce({column}, '')), {_quoted(TOKEN_PATTERN)}, 0)"
    words = ", ".join(map(_quoted, stop_words))
    return f"filter({tokens}, t -> t NOT IN ({words}))" if words else tokens


def zero_shot_prompt(text: Column) -> Column:
    """The whole text inside the question. Shortening a long text to a model's
    window is left to the model, so that the question itself is never cut off."""
    before, after = ZERO_SHOT_PROMPT.split("%s")
    return F.concat(F.lit(before), text, F.lit(after))
