"""Quality rules, line first, with DataFrame functions only.

Each line is judged alone: punctuation (four symbols or more that are over a tenth of its characters), navigation (many separators, or a
few words of a menu without a full stop) and boilerplate (fixed phrases), in English, German, French and Spanish. Failing
lines go; a document that
loses more than MOST_LOST of its word characters goes with them, as does one that fails the base rules:
fewer than 50 words, or more than half of the words in three-word windows that repeat.

Defined results: a null or empty text has no words and fails; whole texts of any length are read; repeated
rows repeat. Three-word windows are compared by 64-bit hashes of word hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]"
MOST_LOST = 0.5
#: What counts as a symbol, as a separator and as boilerplate.
SYMBOLS = "#*$%&|<>"
SYMBOL_SHARE = 0.1
SEPARATORS = "(?:\\||»|«|›|•|·|::| / | > )"
_ENTRIES = (
    "home|menu|login|log in|sign in|sign up|register|search|next|previous|prev|back|contact|about|about us|share|print|top|sitemap|"
    "startseite|anmelden|registrieren|suche|weiter|zur[üÜ]ck|kontakt|teilen|drucken|"
    "accueil|connexion|rechercher|suivant|pr[éÉ]c[éÉ]dent|partager|imprimer|"
    "inicio|buscar|siguiente|anterior|contacto|compartir"
)
MENU = f"(?i)^\\W*(?:skip to content|read more|{_ENTRIES})(?:\\W+(?:{_ENTRIES}))*\\W*$"
BOILERPLATE = (
    "(?i)(?:all rights reserved|accept (?:all )?cookies|cookie policy|privacy policy|terms of (?:use|service)|enable javascript|lorem ipsum|click here to|subscribe to our|copyright (?:\\(c\\)|©)|"
    "alle rechte vorbehalten|datenschutzerkl[äÄ]rung|cookies akzeptieren|nutzungsbedingungen|newsletter abonnieren|hier klicken|"
    "tous droits r[éÉ]serv[éÉ]s|politique de confidentialit[éÉ]|mentions l[éÉ]gales|accepter (?:tous )?les cookies|cliquez ici|"
    "todos los derechos reservados|pol[íÍ]tica de (?:privacidad|cookies)|aviso legal|aceptar (?:todas las )?cookies|haga clic aqu[íÍ])"
)
#: A text with boilerplate holds one of these in lower case, and one with separators one of those.
_PHRASE_MARKS = ("cookie", "rights reserved", "privacy", "terms of", "javascript", "lorem", "click here", "subscribe", "copyright", "vorbehalten", "datenschutz", "nutzungsb", "abonnieren", "hier klicken", "tous droits", "confidential", "mentions l", "cliquez", "derechos", "privacidad", "aviso legal", "haga clic")
_SEPARATOR_MARKS = ("|", "»", "«", "›", "•", "·", "::", " / ", " > ")


def _holds(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in marks))


def line_fails(line: Column, separated: Column, phrased: Column) -> Column:
    """Null-safe verdict on one line; lines without a word pass.

    separated, phrased: whether the text has any mark of separators or phrases, so that most lines are spared the expressions.
    """
    solid = lambda: F.greatest(F.length(F.regexp_replace(line, SPACE + "+", "")), F.lit(1))
    symbols = F.regexp_count(line, F.lit(f"[{SYMBOLS}]"))
    punctuation = (symbols >= 4) & (symbols > SYMBOL_SHARE * solid())
    navigation = (separated & (F.size(F.split(line, SEPARATORS)) > 3)) | ((F.length(line) <= 80) & line.rlike(MENU))
    return punctuation | navigation | (phrased & line.rlike(BOILERPLATE))


INDEX_BITS = 20


def repeated_words(windows: Column, ranked: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more.

    windows: the hash of the window at each word; ranked: sorted longs, the hash's upper bits above the index.
    Neighbours in `ranked` are compared by their whole hashes. Texts with too many words for the index sort
    (hash, index) pairs instead.
    """
    low = F.lit((1 << INDEX_BITS) - 1).cast("long")
    index = lambda x: x.bitwiseAND(low).cast("int")
    same = lambda x, y: F.coalesce((F.shiftright(x, INDEX_BITS) == F.shiftright(y, INDEX_BITS)) & (F.get(windows, index(x)) == F.get(windows, index(y))), F.lit(False))
    short = F.sort_array(F.transform(F.filter(ranked, lambda x, k: same(x, F.get(ranked, k + 1)) | same(x, F.get(ranked, k - 1))), index))
    pairs = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    groups = F.transform(pairs, lambda p, k: F.struct(p["i"].alias("i"), (F.coalesce(F.get(pairs, k + 1)["w"] == p["w"], F.lit(False)) | F.coalesce(F.get(pairs, k - 1)["w"] == p["w"], F.lit(False))).alias("twice")))
    long = F.sort_array(F.transform(F.filter(groups, lambda g: g["twice"]), lambda g: g["i"]))
    return F.when(F.size(windows) < (1 << INDEX_BITS), short).otherwise(long)


def covered(starts: Column) -> Column:
    """Words covered by windows of three that begin at the sorted, distinct `starts`."""
    steps = F.transform(starts, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - x, F.lit(3))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed, lost_share, base_failed, kept, cleaned."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = rows.select(
        "__id",
        F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        _holds(text, _SEPARATOR_MARKS).alias("__separated"),
        _holds(F.lower(text), _PHRASE_MARKS).alias("__phrased"),
        F.transform(F.filter(F.split(text, SPACE + "+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("__hashes"),
        F.split(text, "\n").alias("__all_lines"),
    )
    at = lambda i: F.get(F.col("__hashes"), i)
    n = F.size("__hashes")
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    rows = rows.select("__id", "word_chars", "n_symbols", "__all_lines", n.cast("long").alias("n_words"), F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("__windows"), F.filter("__all_lines", lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("__lines"), F.filter("__all_lines", lambda x: ~line_fails(x, F.col("__separated"), F.col("__phrased"))).alias("__left"))
    high = F.lit(-(1 << INDEX_BITS)).cast("long")
    # Texts whose windows are all different, most of them, aren't ranked.
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    rows = rows.select("*", F.when(repeats, F.sort_array(F.transform("__windows", lambda w, i: w.bitwiseAND(high).bitwiseOR(i.cast("long"))))).alias("__ranked"))
    rows = rows.select("*", F.when(F.col("__ranked").isNull(), F.array().cast("array<int>")).otherwise(repeated_words(F.col("__windows"), F.col("__ranked"))).alias("__starts"))
    left = F.aggregate(F.transform("__left", lambda x: F.length(F.regexp_replace(x, SPACE + "+", ""))), F.lit(0), lambda a, x: a + x)
    rows = rows.select(
        F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered(F.col("__starts")).alias("n_repeat_words"),
        (F.size("__all_lines") - F.size("__left")).cast("long").alias("n_lines_removed"),
        F.when(F.col("word_chars") > 0, 1 - left / F.col("word_chars")).otherwise(0.0).alias("lost_share"),
        F.array_join("__left", "\n").alias("cleaned"),
    )
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= MOST_LOST))
