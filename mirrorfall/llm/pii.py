"""Surrogates for personal data: keyed, of the same kind and format, distinct and consistent; DataFrame operations only.

Names are found behind a title. What a text calls a person behind a title it may call them without one: every word of a name
that was found is replaced wherever it stands in that text. A word of a name has one surrogate in all texts, whatever title
stands before it; the gender that it shows is the one that most titles before it as a first name tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import drop, materialize

#: Titles by the gender they tell, and the letters that names are made of, by script.
MALE_TITLES = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Señorita", "Sra", "Doña", "Госпожа", "Κυρία")
OTHER_TITLES = ("Dr", "Prof", "Professor")
LETTERS = {"latin": ("bdfghklmnprstvwz", "aeiou"), "cyrillic": ("бвгджзклмнпрстфх", "аеиоу"), "greek": ("βγδζθκλμνξπρστφχ", "αειοη")}
ENDINGS = {"latin": {"f": "a", "m": "n", "": "e"}, "cyrillic": {"f": "а", "m": "н", "": "о"}, "greek": {"f": "α", "m": "ς", "": "ι"}}

_TITLE = "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
#: Kinds in the order of precedence, each with its pattern.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w])",
    "secret": r"(?i:password|passwd|pwd|secret|token|api_?key)\s?[=:]\s?\"?[A-Za-z0-9_/+-]{8,}\"?",
    "access_key": r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w+.-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])",
    "card": r"(?<![\w.-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "name": rf"(?<!\w)(?:{_TITLE})\.? \p{{Lu}}\p{{L}}+(?:[ -]\p{{Lu}}\p{{L}}+){{0,2}}(?!\w)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_ROUNDS = 20


def _kind(entity: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _title_gender(mention: Column) -> Column:
    group = lambda titles: rf"^(?:{'|'.join(titles)})\.? "
    return F.when(mention.rlike(group(MALE_TITLES)), "m").when(mention.rlike(group(FEMALE_TITLES)), "f").otherwise("")


def parts(mention: Column, kind: Column) -> Column:
    """What of a mention is replaced as one: arrays of structs (kind, value), so that mentions of one thing share values.

    Digits of a phone or card number whatever their grouping; an address's local part and domain in lower case; a secret
    without the word before it; each word of a name, whatever its case, with the gender that its title tells of a first name.
    """
    one = lambda k, v: F.array(F.struct(k.alias("kind"), v.alias("value"), F.lit("").alias("gender")))
    digits = F.regexp_replace(mention, r"\D", "")
    names = F.regexp_extract_all(F.regexp_replace(mention, rf"^(?:{_TITLE})\.? ", ""), F.lit(r"\p{L}+"), F.lit(0))
    gender = _title_gender(mention)
    return (
        F.when(kind.isin("phone", "card", "ssn"), one(kind, digits))
        .when(kind == "email", one(kind, F.lower(mention)))
        .when(kind == "secret", one(kind, F.regexp_extract(mention, r"([A-Za-z0-9_/+-]{8,})\"?$", 1)))
        # The last word is the family name, or may be, and so tells no gender.
        .when(kind == "name", F.transform(names, lambda w, i: F.struct(F.lit("name").alias("kind"), F.initcap(F.lower(w)).alias("value"), F.when(i == F.size(names) - 1, "").otherwise(gender).alias("gender"))))
        .otherwise(one(kind, mention))
    )


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def surrogate(kind: Column, value: Column, attempt: Column, secret: str) -> Column:
    """The replacement of a value: each letter and digit becomes one of its class, chosen by a keyed digest."""
    seed = F.concat_ws("|", F.lit(secret), kind, value, attempt.cast("string"))
    digest = F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{k}")), 256) for k in range(3)])
    at = lambda i: F.conv(F.substring(digest, (i % 96) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    pick = lambda letters, n: F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))
    is_hex = value.rlike("^[0-9a-f]+$")

    def swap(c: Column, i: Column) -> Column:
        n = at(i)
        lower = F.when(is_hex, pick("abcdef", n)).otherwise(pick("abcdefghijklmnopqrstuvwxyz", n))
        return F.when(c.rlike("[0-9]"), pick("0123456789", n)).when(c.rlike("[a-z]"), lower).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n)).otherwise(c)

    swapped = F.array_join(F.transform(_chars(value), swap), "")
    from_third = lambda text: F.substring(text, F.lit(3), F.length(text))
    top = F.regexp_extract(value, r"(\.[^.]+)$", 1)
    address = F.concat(F.substring(swapped, F.lit(1), F.length(value) - F.length(top)), top)
    octet = lambda k: (at(F.lit(2 * k)) % 254 + 1).cast("string")
    # A country code and a card's first digit stay; no group of a phone number gets a leading zero by accident of its start.
    phone = F.concat(F.substring(value, 1, 1), (at(F.lit(60)) % 8 + 2).cast("string"), from_third(swapped))
    body = F.concat(F.substring(value, 1, 1), F.substring(swapped, F.lit(2), F.length(value) - 2))
    doubled = lambda d: F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
    luhn = F.aggregate(F.transform(F.reverse(_chars(body)), lambda c, i: F.when(i % 2 == 0, doubled(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, d: a + d)
    card = F.concat(body, ((10 - luhn % 10) % 10).cast("string"))

    def name(script: str, gender: str) -> Column:
        consonants, vowels = LETTERS[script]
        syllables = [pick(x, at(F.lit(3 * k + j))) for k in range(4) for j, x in enumerate((consonants, vowels))]
        return F.initcap(F.concat(*syllables, pick(consonants, at(F.lit(50))), F.lit(ENDINGS[script][gender])))

    def scripts(gender: str) -> Column:
        return F.when(value.rlike(r"^\p{IsCyrillic}"), name("cyrillic", gender)).when(value.rlike(r"^\p{IsGreek}"), name("greek", gender)).otherwise(name("latin", gender))

    out = swapped
    for known, made in (
        ("email", address), ("ip", F.concat_ws(".", *[octet(k) for k in range(4)])), ("phone", phone), ("card", card), ("access_key", F.concat(F.lit("AKIA"), F.substring(swapped, 5, 16))),
        ("iban", F.concat(F.substring(value, 1, 2), from_third(swapped))), ("namem", scripts("m")), ("namef", scripts("f")), ("name", scripts("")),
    ):
        out = F.when(kind == known, made).otherwise(out)
    return out


def render(mention: Column, kind: Column, made: Column) -> Column:
    """The mention with the surrogates `made` (an array of strings) in its parts' places, grouping and case kept."""
    first = F.get(made, F.lit(0))
    digits_upto = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), r"\D", ""))
    digits = F.array_join(F.transform(_chars(mention), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(first, digits_upto(i), F.lit(1))).otherwise(c)), "")
    value = F.regexp_extract(mention, r"([A-Za-z0-9_/+-]{8,})\"?$", 1)
    secret = F.concat(F.regexp_replace(mention, r"[A-Za-z0-9_/+-]{8,}\"?$", ""), first, F.when(mention.endswith('"'), '"').otherwise(""))
    joints = F.split(F.regexp_replace(mention, rf"^(?:{_TITLE})\.? ", ""), r"\p{L}+")
    title = F.regexp_extract(mention, rf"^(?:{_TITLE})\.? ", 0)
    words = F.regexp_extract_all(F.regexp_replace(mention, rf"^(?:{_TITLE})\.? ", ""), F.lit(r"\p{L}+"), F.lit(0))
    cased = F.zip_with(words, made, lambda w, new: F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(new)).otherwise(new))
    name = F.concat(title, F.array_join(F.zip_with(joints, cased, lambda gap, w: F.concat(gap, F.coalesce(w, F.lit("")))), ""))
    email = F.when(mention == F.upper(mention), F.upper(first)).otherwise(first)
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "email", email).when((kind == "secret") & (value != ""), secret).when(kind == "name", name).otherwise(first)


def surrogate_table(values: DataFrame, secret: str) -> DataFrame:
    """A table (kind, value, made) for the distinct (kind, value) of `values`.

    A surrogate that two values share, or that is itself a value of the corpus, is made anew for all but the least value,
    with the next attempt, until none is left; so different values stay different and nobody gets another's data.
    """
    known = materialize(values.select("kind", "value").distinct().withColumn("attempt", F.lit(0)), "pii-values")
    for _ in range(_ROUNDS):
        made = materialize(known.withColumn("made", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), secret)), "pii-surrogates")
        drop(known)
        shared = made.groupBy("made").agg(F.count("*").alias("n"), F.min(F.struct("value", "kind")).alias("least")).where("n > 1").select("made", "least")
        real = made.select(F.col("value").alias("made")).distinct().withColumn("real", F.lit(True))
        marks = materialize(made.select("made").distinct().join(shared, "made", "left").join(real, "made", "left").where("least is not null or real"), "pii-collisions")
        if marks.isEmpty():
            drop(marks)
            return made
        again = F.coalesce("real", F.lit(False)) | (F.col("least").isNotNull() & (F.col("least") != F.struct("value", "kind")))
        known = materialize(made.join(marks, "made", "left").select("kind", "value", (F.col("attempt") + again.cast("int")).alias("attempt")), "pii-values")
        drop(made, marks)
    raise RuntimeError(f"surrogates still collide after {_ROUNDS} attempts")


def _name_words(mentions: Column) -> Column:
    """The distinct words of the names among a text's mentions, as written and in capitals."""
    titled = F.filter(mentions, lambda m: m.rlike(rf"^(?:{_TITLE})\.? \p{{Lu}}"))
    words = F.flatten(F.transform(titled, lambda m: F.regexp_extract_all(F.regexp_replace(m, rf"^(?:{_TITLE})\.? ", ""), F.lit(r"\p{L}+"), F.lit(0))))
    capital = F.transform(words, lambda w: F.initcap(F.lower(w)))
    return F.array_distinct(F.concat(words, capital, F.transform(words, lambda w: F.upper(w))))


def replace_personal_data(docs: DataFrame, secret: str) -> DataFrame:
    """Documents with surrogates for the personal data in `text`, and n_entities, how many mentions were replaced.

    One value has one surrogate in all documents. Texts are searched once; only those with a mention are shuffled. A null or
    empty text stays as it is, with no mentions. Rows that repeat an id and text get the same result, null ids included. A
    column n_entities of docs gives way to the new one. An empty table gives no rows; a text is searched within one row,
    whatever its length.
    """
    keep = [c for c in docs.columns if c.lower() != "n_entities"]
    none = F.array().cast("array<string>")
    rows = docs.select(F.struct(*keep).alias("row"))
    marked = materialize(rows.withColumns({"hash": F.xxhash64("row.text"), "mentions": F.coalesce(F.regexp_extract_all("row.text", F.lit(ANY), F.lit(0)), none)}), "pii-marked")
    # Where names were found, their words are searched for as well.
    words = F.col("words")
    pattern = F.when(F.size(words) > 0, F.concat(F.lit(ANY + r"|(?<!\p{L})(?:"), F.array_join(words, "|"), F.lit(r")(?!\p{L})"))).otherwise(F.lit(ANY))
    found = marked.where(F.size("mentions") > 0).withColumn("words", _name_words(F.col("mentions"))).withColumn("pattern", pattern)
    found = found.select("row", "hash", F.regexp_extract_all("row.text", F.col("pattern"), F.lit(0)).alias("mentions"), F.split("row.text", F.col("pattern"), -1).alias("between"))
    found = materialize(found, "pii-found")

    each = found.select(F.col("row.doc_id").alias("id"), "hash", F.posexplode("mentions").alias("i", "mention")).groupBy("id", "hash", "i").agg(F.first("mention").alias("mention"))
    each = materialize(each, "pii-mentions")
    kinds = each.groupBy("mention").agg(F.count("*").alias("n")).withColumn("kind", _kind(F.col("mention")))
    kinds = materialize(kinds.withColumn("parts", parts(F.col("mention"), F.col("kind"))), "pii-kinds")
    pieces = kinds.select("mention", "n", F.posexplode("parts").alias("k", "part")).select("mention", "n", "k", "part.*")
    told = lambda g: F.sum(F.when(F.col("gender") == g, F.col("n")).otherwise(0))
    genders = pieces.where("kind = 'name'").groupBy("value").agg((told("m") - told("f")).alias("lean"))
    genders = genders.select("value", F.concat(F.lit("name"), F.when(F.col("lean") > 0, "m").when(F.col("lean") < 0, "f").otherwise("")).alias("named"))
    pieces = pieces.join(genders, "value", "left").select("mention", "k", "value", F.when(F.col("kind") == "name", F.col("named")).otherwise(F.col("kind")).alias("kind"))
    pieces = materialize(pieces, "pii-pieces")
    made = surrogate_table(pieces, secret)
    by_mention = pieces.join(made, ["kind", "value"]).groupBy("mention").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "made"))), lambda x: x["made"]).alias("made"))
    shown = materialize(kinds.join(by_mention, "mention").select("mention", render(F.col("mention"), F.col("kind"), F.col("made")).alias("shown")), "pii-shown")
    drop(kinds, pieces, made)
    per_text = each.join(shown, "mention").groupBy("id", "hash").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "shown"))), lambda x: x["shown"]).alias("shown"))
    per_text = materialize(per_text.withColumnsRenamed({"id": "of", "hash": "of_hash"}), "pii-texts")
    drop(each, shown)
    joined = found.join(per_text, F.col("row.doc_id").eqNullSafe(F.col("of")) & F.col("hash").eqNullSafe(F.col("of_hash")))
    text = F.array_join(F.zip_with("between", "shown", lambda gap, s: F.concat(gap, F.coalesce(s, F.lit("")))), "")
    columns = lambda new: [new.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in keep]
    changed = joined.select(*columns(text), F.size("mentions").cast("long").alias("n_entities"))
    same = marked.where(F.size("mentions") == 0).select(*columns(F.col("row.text")), F.lit(0).cast("long").alias("n_entities"))
    return changed.unionByName(same)


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced: doc_id, text, n_entities. Null and empty texts stay as they are; rows
    that repeat an id and text get the same result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_personal_data(docs, "mirrorfall").select("doc_id", "text", "n_entities")
