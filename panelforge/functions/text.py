"""Text statistics as column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PUNCTUATION = r"""[!-/:-@\[-`{-~]"""

# Common English function words.
STOP_WORDS = (
    "a about after all also an and any are as at be because been before being but by can could did do does for from "
    "had has have he her here him his how i if in into is it its just me more most my no not of on only or other our "
    "out over she should so some such than that the their them then there these they this those through to too under "
    "until up very was we were what when where which while who whom why will with would you your"
).split()


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def words(c) -> Column:
    """Parts between runs of white space."""
    return F.array_remove(F.split(_c(c), r"\s+"), "")


def tokens(c) -> Column:
    """Parts between single spaces, empty ones included."""
    return F.split(_c(c), " ")


def text_counts(c) -> dict[str, Column]:
    """Characters, words, parts between full stops, distinct words."""
    return {
        "char_count": F.length(_c(c)), "word_count": F.size(words(c)),
        "sentence_count": F.size(F.split(_c(c), r"\.")), "unique_words": F.size(F.array_distinct(words(c))),
    }


def pattern_count(c, regex: str) -> Column:
    return F.regexp_count(_c(c), F.lit(regex))


def quoted_count(c) -> Column:
    """Spans between double quotes on one line."""
    return pattern_count(c, '"(.*?)"')


def dots_count(c) -> Column:
    return pattern_count(c, r"\.{3,4}")


def quotes_found(text, ref) -> Column:
    """Quoted spans of the text that occur in the other text."""
    spans = F.regexp_extract_all(_c(text), F.lit('"([^"]*)"'), F.lit(1))
    return F.size(F.filter(spans, lambda q: F.contains(_c(ref), q)))


def ngrams(arr: Column, n: int) -> Column:
    """Distinct runs of n neighbouring words, joined by a space."""
    size, runs = F.size(arr), arr
    kept = F.greatest(size - (n - 1), F.lit(0))
    for i in range(1, n):
        runs = F.zip_with(F.slice(runs, 1, kept), F.slice(arr, i + 1, kept), lambda x, y: F.concat_ws(" ", x, y))
    return F.array_distinct(runs)


def ngram_overlap(a, b, n: int) -> Column:
    """Distinct n-grams that both texts have."""
    return F.size(F.array_intersect(ngrams(tokens(a), n), ngrams(tokens(b), n)))


def _is_stop(w, stop):
    return w.isin(*stop)


def word_overlap(a, b, stop=STOP_WORDS) -> Column:
    """Distinct words, stop words left out, that both texts have."""
    return F.size(F.array_except(F.array_intersect(words(a), words(b)), F.array(*[F.lit(w) for w in stop])))


def char_class_counts(c, stop=STOP_WORDS, split=None) -> dict[str, Column]:
    """Punctuation, stop words, upper-case words, characters per word, words per sentence, longest word.

    ``split`` is a column that already holds ``words(c)``, so the text is split once.
    """
    w = words(c) if split is None else split
    n = F.size(w)
    return {
        "punctuation": pattern_count(c, PUNCTUATION),
        "stop_words": F.size(F.filter(w, lambda x: _is_stop(F.lower(x), stop))),
        "upper_words": F.size(F.filter(w, lambda x: (x == F.upper(x)) & x.rlike("[A-Z]"))),
        "word_density": F.length(_c(c)) / (n + 1),
        "words_per_sentence": n / F.size(F.split(_c(c), r"\.")),
        "longest_word": F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)),
    }


def word_length_stats(c, split=None) -> dict[str, Column]:
    """Mean and median word length; NULL without words. ``split`` as in ``char_class_counts``."""
    w = words(c) if split is None else split
    a = F.sort_array(F.transform(w, F.length))
    n = F.size(w)
    mean = F.length(F.array_join(w, "")) / F.when(n > 0, n)
    mid = (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2
    return {"word_len_mean": mean, "word_len_median": F.when(n > 0, mid)}


# Symbol and column name.
SYMBOLS = {".": "periods", ",": "commas", ";": "semicolons", "!": "exclamations", "?": "questions"}


def symbol_counts(c, symbols=None) -> dict[str, Column]:
    """Count per symbol, share of distinct words, longest and mean part between spaces."""
    c, t = _c(c), tokens(c)
    out = {name: F.length(c) - F.length(F.replace(c, F.lit(s), F.lit(""))) for s, name in (symbols or SYMBOLS).items()}
    n = F.size(t)
    lengths = F.transform(t, F.length)
    return out | {
        "diversity": F.size(F.array_distinct(t)) / n, "longest": F.array_max(lengths),
        "mean_len": (F.length(c) - (n - 1)) / n,
    }


def syllables(word: Column) -> Column:
    """Syllables of an English word, estimated: vowel groups less a silent final e, at least 1."""
    w = F.lower(word)
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    silent = (w.rlike("[^aeiouy]e$") & ~w.rlike("le$")).cast("int")
    return F.greatest(groups - silent, F.lit(1))


def readability(c) -> dict[str, Column]:
    """Readability grades from characters, words, sentences and estimated syllables.

    Words are runs of letters, sentences runs ended by . ! or ?; NULL without words.
    """
    w = F.regexp_extract_all(_c(c), F.lit(r"\p{L}+"), F.lit(0))
    n = F.size(w).cast("double")
    n = F.when(n > 0, n)
    s = F.greatest(F.regexp_count(_c(c), F.lit("[.!?]+")), F.lit(1)).cast("double")
    total = lambda f: F.aggregate(w, F.lit(0), lambda acc, x: acc + f(x)).cast("double")
    chars, syl = total(F.length), total(syllables)
    poly = total(lambda x: (syllables(x) >= 3).cast("int"))
    long_ = total(lambda x: (F.length(x) > 6).cast("int"))
    wps, spw, cpw = n / s, syl / n, chars / n
    linsear = (n + 2 * poly) / s
    return {
        "syllables": syl, "ari": 4.71 * cpw + 0.5 * wps - 21.43, "coleman_liau": 5.88 * cpw - 29.6 * s / n - 15.8,
        "smog": 1.043 * F.sqrt(poly * 30 / s) + 3.1291, "linsear": F.when(linsear > 20, linsear / 2).otherwise((linsear - 2) / 2),
        "kincaid": 0.39 * wps + 11.8 * spw - 15.59, "flesch": 206.835 - 1.015 * wps - 84.6 * spw,
        "fog": 0.4 * (wps + 100 * poly / n), "lix": wps + 100 * long_ / n, "rix": long_ / s,
    }


def clean_text(c, stop=STOP_WORDS) -> Column:
    """Letters only, lower case, stop words removed."""
    kept = F.filter(words(F.lower(F.regexp_replace(_c(c), "[^a-zA-Z]", " "))), lambda w: ~_is_stop(w, stop))
    return F.array_join(kept, " ")


def concat_text(cols, sep=" ") -> Column:
    """Texts joined in order; NULL counts as empty."""
    return F.concat_ws(sep, *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols])
