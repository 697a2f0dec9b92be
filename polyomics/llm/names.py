"""Problem 2: freely typed names mapped to the entries of a canonical list, the rest reported as unmatched.

A symmetric-delete dictionary: every spelling of an entry, and every string it becomes when one letter is taken out, is a key, as is
the spelling with look-alike signs folded into one. A name is looked for anywhere in the typed text: runs of its words are the
candidates, so that no list of remarks is needed. Pairs that share a key are ranked by a weighted Damerau-Levenshtein distance, in
which another digit is no slip, then by how often the entry is named verbatim. Everything runs inside the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyomics.operators.skew import join_groups
from polyomics.session import materialize

#: A run of words is an entry's name if their distance is at most this, and it has at least FUZZY letters and digits; shorter ones must
#: be equal.
BOUND = 1.0
FUZZY = 4
#: Rows of the dictionary up to which it is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Words of an entry up to which every order of them is a spelling; of longer ones the rotations are.
ORDERED = 3
#: Letters of an abbreviated word at least.
ABBREVIATED = 3

# Signs easily taken for each other, each with the one that stands for them, and the nouns a name of a kind may have in it.
FOLD_FROM, FOLD_TO = "olisbzg", "0115826"
NOUNS = {"base_medium": ["medium", "vollmedium", "mix"], "strain": ["strain"]}
#: What parts the members of a list in one text: a comma or slash only with a blank.
LIST = r"\s*[;|]\s*|\s*\n\s*|\s+/\s+|,\s+"
#: What may stand between a word and the number that belongs to it.
GLUE = r"(?<=\p{L})[\s\u00a0\u2000-\u200b\ufeff_-]+(?=\p{N})"


def fold(c: Column) -> Column:
    return F.translate(c, FOLD_FROM, FOLD_TO)


def words_of(c: Column) -> Column:
    """The runs of letters and digits of a text in lower case; a number belongs to the word before it, if blanks, ``-`` or ``_`` part them."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(c), GLUE, ""), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def runs(words: Column, most: Column, longest: Column) -> Column:
    """Up to ``most`` neighbouring words joined, each of at most ``longest`` letters and digits."""
    sizes = lambda i: F.sequence(F.lit(1), F.least(most, F.size(words) - i + 1))
    every = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(sizes(i), lambda n: F.array_join(F.slice(words, i, n), ""))))
    return F.when(F.size(words) > 0, F.array_distinct(F.filter(every, lambda r: F.length(r) <= longest))).otherwise(F.array().cast("array<string>"))


def _orders(names: DataFrame) -> DataFrame:
    """``names`` (ref_id, kind, words) with every order of up to ORDERED words, the rotations of more."""
    turns = F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda k: F.concat(F.slice("words", k + 1, F.size("words")), F.slice("words", F.lit(1), k)))
    swapped = F.when(F.size("words") <= ORDERED, F.transform(turns, lambda w: F.reverse(w))).otherwise(F.array().cast("array<array<string>>"))
    return names.withColumn("words", F.explode(F.array_distinct(F.concat(turns, swapped))))


def _short(word: Column) -> Column:
    """A word and its abbreviations: its beginnings, and those of its consonants after the first letter, of at least ABBREVIATED letters."""
    bones = F.concat(F.substring(word, 1, 1), F.regexp_replace(F.substring(word, F.lit(2), F.length(word)), "[aeiouy]", ""))
    cut = lambda w: F.when(F.length(w) >= ABBREVIATED, F.transform(F.sequence(F.lit(ABBREVIATED), F.length(w)), lambda k: F.substring(w, F.lit(1), k))).otherwise(F.array().cast("array<string>"))
    letters = word.rlike(r"^\p{L}+$")
    return F.when(letters, F.array_distinct(F.concat(F.array(word), cut(word), cut(bones)))).otherwise(F.array(word))


def spellings(canon: DataFrame) -> DataFrame:
    """ref_id, kind, spelling: letters and digits of each entry's name and synonyms; of names of several words also every order of them, the
    words after the first abbreviated, and the last of three or more left out; and a noun of the kind after the first word or the last. A
    spelling made by these rules that two entries share is neither's; one that is an entry's own name is that entry's.

    Null names and synonyms give none. The list is clean and short; the work is a few narrow maps and one aggregation over it."""
    names = F.concat(F.array("ref_name"), F.split(F.coalesce("synonyms", F.lit("")), r"\s*;\s*"))
    s = canon.select("ref_id", "kind", F.explode(names).alias("name")).select("ref_id", "kind", words_of(F.col("name")).alias("words")).where("size(words) > 0")
    joined = lambda df, made: df.select("ref_id", "kind", F.array_join("words", "").alias("spelling"), F.lit(made).alias("made"))
    several = s.where("size(words) > 1")
    head, rest = F.slice("words", F.lit(1), F.lit(1)), F.slice("words", F.lit(2), F.size("words"))
    short = F.aggregate(rest, F.array(head), lambda done, w: F.flatten(F.transform(done, lambda d: F.transform(_short(w), lambda v: F.concat(d, F.array(v))))))
    short = _orders(several.select("ref_id", "kind", F.explode(short).alias("words")))
    full = _orders(s.unionByName(s.where("size(words) > 2").select("ref_id", "kind", F.slice("words", F.lit(1), F.size("words") - 1).alias("words"))))
    nouns = F.coalesce(*[F.when(F.col("kind") == k, F.array(*map(F.lit, w))) for k, w in NOUNS.items()])
    noun = full.select("ref_id", "kind", "words", F.explode(nouns).alias("noun"))
    inside = F.explode(F.array(F.concat("words", F.array("noun")), F.concat(head, F.array("noun"), rest)))
    every = reduce(DataFrame.unionByName, [joined(s, 0), joined(short, 1), joined(full, 1), joined(noun.select("ref_id", "kind", inside.alias("words")), 1)])
    g = every.groupBy("kind", "spelling").agg(F.min("made").alias("least"), F.array_distinct(F.collect_list(F.struct("made", "ref_id"))).alias("refs"))
    of = F.array_distinct(F.transform(F.filter("refs", lambda r: r["made"] == F.col("least")), lambda r: r["ref_id"]))
    return g.select("kind", "spelling", of.alias("refs"), "least").where("least = 0 or size(refs) = 1").select("kind", "spelling", F.explode("refs").alias("ref_id"))


def keys(word: Column) -> Column:
    """What two strings share if their distance is within BOUND: one of the strings with one letter less, or, for two look-alikes, the
    folded string. A word shorter than FUZZY has only itself."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.when(F.length(word) >= FUZZY, F.array_distinct(F.concat(F.array(word, F.concat(F.lit("~"), fold(word))), cut))).otherwise(F.array(word))


def distance(a: Column, b: Column) -> Column:
    """Damerau-Levenshtein distance with weights, null if above BOUND: 0.5 for a look-alike, 0.8 for two neighbours swapped, 0.9 for a
    letter doubled or one of a pair missing, 1 for another slip; 3 for a digit in place of another, which makes another number.

    With these weights only one slip, or two look-alikes, are within the bound, so that the cases can be told apart by position."""
    differ = F.filter(
        F.transform(F.sequence(F.lit(1), F.length(a)), lambda i: F.struct(i.alias("i"), F.substring(a, i, 1).alias("x"), F.substring(b, i, 1).alias("y"))), lambda d: d["x"] != d["y"]
    )
    first, second = (lambda d: F.get(d, F.lit(0))), (lambda d: F.get(d, F.lit(1)))

    def replaced(d: Column) -> Column:
        alike = F.forall(d, lambda p: fold(p["x"]) == fold(p["y"]))
        digits = F.rlike(first(d)["x"], F.lit(r"\p{Nd}")) & F.rlike(first(d)["y"], F.lit(r"\p{Nd}"))
        crossed = (second(d)["i"] == first(d)["i"] + 1) & (first(d)["x"] == second(d)["y"]) & (first(d)["y"] == second(d)["x"])
        return F.when(F.size(d) == 0, F.lit(0.0)).when((F.size(d) == 2) & crossed, 0.8).when((F.size(d) <= 2) & alike, F.size(d) * 0.5).when((F.size(d) == 1) & ~digits, 1.0)

    def inserted(long: Column, short: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(1), F.length(long)), lambda i: F.concat(F.substring(long, F.lit(1), i - 1), F.substring(long, i + 1, F.length(long))) == short)
        return F.when(F.exists(fits, lambda i: (i > 1) & (F.substring(long, i, 1) == F.substring(long, i - 1, 1))), 0.9).when(F.size(fits) > 0, 1.0)

    same = F.get(F.transform(F.array(differ), replaced), F.lit(0))
    return F.when(a == b, F.lit(0.0)).when(F.length(a) == F.length(b), same).when(F.length(a) == F.length(b) + 1, inserted(a, b)).when(F.length(b) == F.length(a) + 1, inserted(b, a))


def resolve(typed: DataFrame, canon: DataFrame) -> DataFrame:
    """kind, word, ref_id, n (rows of the word) of each distinct (kind, word) of ``typed`` that means an entry of ``canon``; others give
    no row.

    ``typed`` has kind and word (the words of :func:`words_of`, parted by blanks). The dictionary is broadcast while it has at most
    BROADCAST_ROWS rows, which is counted. Each distinct text is looked up once, verbatim runs first; only texts without one are
    looked up by their keys, and the pairs that share a key are compared. The best is kept by aggregation: smallest distance, then the
    longest run, then the entry named verbatim most often, then the smallest ref_id.
    """
    s = materialize(spellings(canon), "spellings")
    d = s.where(F.length("spelling") >= FUZZY).withColumn("key", F.explode(keys(F.col("spelling"))))
    size = s.agg(F.sum(F.length("spelling") + 2).alias("rows"), F.coalesce(F.max(F.length("spelling")), F.lit(0)).alias("longest")).first()
    most = canon.select(F.explode(F.concat(F.array("ref_name"), F.split(F.coalesce("synonyms", F.lit("")), ";"))).alias("name")).agg(F.max(F.size(words_of(F.col("name"))))).first()[0] or 0
    few = (size["rows"] or 0) <= BROADCAST_ROWS
    hint = F.broadcast if few else (lambda df: df)
    words = typed.groupBy("kind", "word").agg(F.count("*").alias("n")).where("word <> ''")
    run = runs(F.split("word", " "), F.lit(most + 1), F.lit(size["longest"] + 1))
    exact = words.select("kind", "word", "n", F.explode_outer(run).alias("run")).join(hint(s.withColumnRenamed("spelling", "run")), ["kind", "run"], "left")
    best = F.min_by("ref_id", F.when(F.col("ref_id").isNotNull(), F.struct(-F.length("run"), "ref_id")))
    exact = materialize(exact.groupBy("kind", "word").agg(F.max("n").alias("n"), best.alias("ref_id")), "exact")
    frequency = exact.where("ref_id is not null").groupBy("kind", "ref_id").agg(F.sum("n").alias("named"))
    rest = exact.where("ref_id is null").select("kind", "word", "n", F.explode(run).alias("run")).where(F.length("run") >= FUZZY)
    found = rest.select("*", F.explode(keys(F.col("run"))).alias("key")).join(hint(d), ["kind", "key"]).select("kind", "word", "n", "run", "ref_id", "spelling").distinct()
    found = found.withColumn("distance", distance(F.col("run"), F.col("spelling"))).where(F.col("distance") <= BOUND)
    found = found.groupBy("kind", "word", "ref_id").agg(F.max("n").alias("n"), F.min(F.struct("distance", -F.length("run"))).alias("best")).join(hint(frequency), ["kind", "ref_id"], "left")
    near = found.groupBy("kind", "word").agg(F.min_by("ref_id", F.struct("best", -F.coalesce("named", F.lit(0)), "ref_id")).alias("ref_id"), F.max("n").alias("n"))
    return exact.where("ref_id is not null").select("kind", "word", "ref_id", "n").unionByName(near)


def typed_names(strains: DataFrame, media: DataFrame) -> DataFrame:
    """field_name, record_key, kind, typed, word: every non-blank typed name; each member of alternate_names is a row."""
    name = strains.select(F.lit("strain.name").alias("field_name"), F.col("accession").alias("record_key"), F.lit("strain").alias("kind"), F.col("name").alias("typed"))
    members = F.explode(F.split("alternate_names", LIST))
    alternate = strains.where(F.trim("alternate_names") != "").select(F.lit("strain.alternate_names").alias("field_name"), F.col("accession").alias("record_key"), F.lit("strain").alias("kind"), members.alias("typed"))
    base = media.select(F.lit("medium.base_medium").alias("field_name"), F.col("medium_id").alias("record_key"), F.lit("base_medium").alias("kind"), F.col("base_medium").alias("typed"))
    rows = reduce(DataFrame.unionByName, [name, alternate, base]).where(F.regexp_replace("typed", r"[\s\u00a0]", "") != "")
    return rows.withColumn("word", F.array_join(words_of(F.col("typed")), " "))


def match(strains: DataFrame, media: DataFrame, canon: DataFrame) -> DataFrame:
    """field_name, record_key, ref_id: the entries that the names of each record mean, or one row with 0 if they mean none.

    A record with a null or blank name, or a null key, gives no row for that field. Repeated records of a key count once. A name that a
    third of all records bear is salted in the join.
    """
    typed = typed_names(strains, media).where("record_key is not null")
    found = join_groups(typed, resolve(typed, canon), ["kind", "word"], "n", "record_key")
    hits = found.groupBy("field_name", "record_key").agg(F.collect_set("ref_id").alias("hits"))
    return hits.select("field_name", "record_key", F.explode(F.when(F.size("hits") > 0, F.col("hits")).otherwise(F.array(F.lit(0).cast("bigint")))).alias("ref_id"))


def unmatched(strains: DataFrame, media: DataFrame, canon: DataFrame) -> DataFrame:
    """kind, typed, n: the texts as typed that mean no entry, and how often each occurs."""
    typed = typed_names(strains, media)
    found = join_groups(typed, resolve(typed, canon), ["kind", "word"], "n", "record_key")
    return found.where("ref_id is null").groupBy("kind", "typed").agg(F.count("*").alias("n"))
