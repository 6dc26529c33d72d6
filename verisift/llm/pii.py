"""Surrogates for personal data, by DataFrame functions only.

Detectors find e-mail and network addresses, phone, card, account and social-security numbers, secrets and names behind
a title. An entity's identity is its normal form (digits of a number, lower case of an address), so all spellings of one
entity share one surrogate. The surrogate is drawn by a keyed hash, letter for letter and digit for digit, and laid into
the spelling at hand: layout, separators and case stay, as do a phone number's country code, an address's last label,
a secret's prefix, a card's first digit and an account's country; check digits (cards, accounts) are computed anew.

Names are replaced word for word: a person is a given name (with a gender and a script) and a surname (with a script),
and each of the two has one surrogate in the whole corpus. So full and short, titled and untitled mentions agree, and two
persons get one surrogate only if they have one name. Words of a name that a title marks anywhere in a document are
replaced wherever they stand as a capitalised word in that document. A given name's gender is that of its titles in the
document, else in the corpus; Slavic surnames keep their ending. Hebrew has no capitals: one word behind the title counts.
Initials stay.

Surrogates are checked over the whole corpus: if two entities would get the same one, or a surrogate is itself an entity
of the corpus, the entity with the larger hash tries again with the next attempt number, until no collision is left.

Scale: texts are searched once and the matches written; texts that cannot hold an entity are not shuffled. Entities are
made distinct before the collision check. Each text's entities are put back by position: the text is split at the
matches and joined with the surrogates, so a surrogate is never searched again. Keys with more than one in 256 of the
rows (at most 256 keys) are salted or broadcast.

Defined results: null text stays null, empty text stays empty; equal rows get equal texts; documents without entities
are unchanged; numbers of card length are cards only with a right check digit and a first digit of 2 to 6; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, own_names, pieces

#: Titles, detectors (first match wins) and for each a part that all of its matches hold. Fixed values.
TITLES_M, TITLES_F, TITLES_N = "Mr|Herr|Monsieur|Señor|г-н|מר", "Mrs|Ms|Miss|Frau|Madame|Mademoiselle|Señora|Señorita|г-жа|גברת", "Dr|Prof|Professor"
TITLE = rf"(?<![\p{{L}}])(?:{TITLES_M}|{TITLES_F}|{TITLES_N})\.? "
NAME_WORD = r"\p{Lu}[\p{L}\p{M}'’-]{1,30}+"
DETECTORS: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?![0-9]|\.[0-9])",
    "ip6": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![0-9A-Za-z:])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{2,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9](?:[ .-]?[0-9]){6,}+|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|xox[abprs]-[A-Za-z0-9-]{10,72}|AIza[0-9A-Za-z_-]{35}|glpat-[A-Za-z0-9_-]{20})(?![0-9A-Za-z])",
    "name": rf"{TITLE}(?:(?:\p{{Lu}}\. ?)*{NAME_WORD}(?: (?:\p{{Lu}}\. )*{NAME_WORD})?|\p{{IsHebrew}}{{2,30}}+)",
}
LIKELY_PARTS: dict[str, str] = {
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]{1,3}\.[0-9]", "ip6": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "ssn": r"[0-9]-[0-9]{2}-[0-9]{4}",
    "phone": r"\([0-9]{2,4}\)|\+[0-9]|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}", "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "card": r"[0-9](?:[ -]?[0-9]){12}",
    "secret": r"[0-9a-f]{32}|[0-9A-F]{32}|AKIA|gh[pousr]_|sk-[A-Za-z0-9]|xox[abprs]-|AIza|glpat-", "name": rf"(?:{TITLES_M}|{TITLES_F}|{TITLES_N})\.? \p{{L}}",
}
ANY = "|".join(DETECTORS.values())
#: The same and every word that may repeat a name: for documents with names.
ANY_WORD = rf"{ANY}|(?<![\p{{L}}\p{{M}}])(?:\p{{Lu}}[\p{{L}}\p{{M}}]{{1,30}}+|\p{{IsHebrew}}{{2,30}}+)"
LIKELY = "|".join(LIKELY_PARTS.values())
WORD = r"[\p{L}\p{M}]{2,}"
#: Country calling codes of one and two digits; the others have three. Fixed values.
CALLING = r"^\+(1|7|2[07]|3[0123469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
PREFIX = r"^(AKIA|gh[pousr]_|sk-|xox[abprs]-|AIza|glpat-)"

#: Given names by script and gender, syllables by script. Fixed values.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Leon Marco Nils Oscar Paul Rafael Simon",
    ("latin", "f"): "Alba Berta Clara Diana Elena Flora Greta Hanna Irene Julia Laura Maria Nora Olga Paula Sofia",
    ("latin", "n"): "Alex Charlie Chris Jamie Jesse Kim Robin Sam",
    ("cyrillic", "m"): "Антон Борис Вадим Глеб Денис Егор Иван Кирилл",
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Ирина Лидия Нина",
    ("cyrillic", "n"): "Женя Саша Валя Шура",
    ("hebrew", "m"): "אבי גיל דן יואב נדב עמית רון תומר",
    ("hebrew", "f"): "אורית גלית דנה יעל נועה עדי רונית תמר",
    ("hebrew", "n"): "טל שי נועם ליאור",
}
SYLLABLES = {"latin": "bar den fol gan hel kor lin mar nel por ras sil tan vel win zor", "cyrillic": "бар ден фол ган хел кор лин мар нел пор рас сил тан вел вин зор", "hebrew": "בר דן פל גן חל קר לן מר נל פר רס של תן ול ין צר"}
SLAVIC = r"^(.{2,}?)((?:ов|ев|ёв|ин)а?)$"


def type_of(entity: Column) -> Column:
    """The detector that a match comes from; null for words of ``ANY_WORD`` and for numbers that are no cards."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(DETECTORS.items()):
        here = F.lit(name)
        if name == "card":
            here = F.when(F.call_function("luhn_check", F.regexp_replace(entity, "[ -]", "")) & entity.rlike("^[2-6]"), name)
        out = F.when(entity.rlike(f"^(?:{pattern})$"), here).otherwise(out)
    return out


def script_of(entity: Column) -> Column:
    return F.when(entity.rlike(r"\p{IsCyrillic}"), "cyrillic").when(entity.rlike(r"\p{IsHebrew}"), "hebrew").otherwise("latin")


def normal_form(kind: Column, entity: Column) -> Column:
    """What makes two spellings one entity (other than names)."""
    bare = F.upper(F.regexp_replace(entity, r"[^0-9A-Za-z]", ""))
    return (
        F.when(kind.isin("email", "ip6") | ((kind == "secret") & ~entity.rlike(PREFIX)), F.lower(entity))
        .when(kind == "secret", entity)
        .when(kind == "ip", F.array_join(F.transform(F.split(entity, r"\."), lambda x: x.cast("int").cast("string")), "."))
        .when((kind == "phone") & entity.startswith("+"), F.concat(F.lit("+"), bare))
        .otherwise(bare)
    )


def stream(key: str, kind: Column, normal: Column, attempt: Column) -> Column:
    """512 keyed bits as 128 hex digits."""
    return F.sha2(F.concat_ws("\x01", F.lit(key), kind, normal, attempt.cast("string")), 512)


def byte(bits: Column, i: Column) -> Column:
    return F.conv(F.substr(bits, F.pmod(i * 2, F.lit(128)) + 1, F.lit(2)), 16, 10).cast("int")


def pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), F.pmod(n, F.lit(len(words))) + 1)


def luhn_digit(payload: Column) -> Column:
    """The check digit behind these digits."""
    n = F.length(payload)
    digit = lambda c, i: c.cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
    each = F.transform(F.split(payload, ""), lambda c, i: digit(c, i) - F.when(digit(c, i) > 9, 9).otherwise(0))
    return F.pmod(-F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(10)).cast("string")


def iban_digits(country: Column, account: Column) -> Column:
    """The two check digits of an account number."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), step)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def surrogate(kind: Column, normal: Column, bits: Column, attempt: Column) -> Column:
    """The surrogate's normal form: same letter classes at the same places."""
    hexes, letters, digits = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    nth = lambda alphabet, i: F.substr(F.lit(alphabet), F.pmod(byte(bits, i), F.lit(len(alphabet))) + 1, F.lit(1))
    hexed = (kind == "ip6") | ((kind == "secret") & normal.rlike("^[0-9a-f]+$"))
    # what stays: a head (country, brand, prefix), an address's last label
    head = F.when(kind == "iban", 2).when(kind == "card", 1).when(kind == "secret", F.length(F.regexp_extract(normal, PREFIX, 1))).when(kind == "phone", F.length(F.regexp_extract(normal, CALLING, 0))).otherwise(0)
    tail = F.length(normal) - F.when(kind == "email", F.length(F.regexp_extract(normal, r"\.[a-z]+$", 0))).otherwise(0)
    drawn = F.transform(
        F.split(normal, ""),
        lambda c, i: F.when((i < head) | (i >= tail) | ~c.rlike("^[0-9A-Za-z]$"), c)
        .when(hexed, nth(hexes, i))
        .when(c.rlike("^[0-9]$"), nth(digits, i))
        .when(c.rlike("^[a-z]$"), nth(letters, i))
        .otherwise(F.upper(nth(letters, i))),
    )
    plain = F.array_join(drawn, "")
    payload = F.substr(plain, F.lit(1), F.length(plain) - 1)
    account = F.substr(plain, F.lit(5))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(byte(bits, i), F.lit(254)) + 1).cast("string")), ".")
    part, person = F.split(normal, r"\|"), F.lit(None).cast("string")
    for (script, gender), given in GIVEN.items():
        syllable = lambda script: lambda i: pick(SYLLABLES[script].split(), byte(bits, i))
        more = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2) + attempt), syllable(script)), "")
        longer = F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), syllable(script)), "")).otherwise("")
        person = F.when((kind == "given") & (part[0] == script) & (part[1] == gender), F.concat_ws("|", part[0], part[1], F.concat(F.lower(pick(given.split(), byte(bits, F.lit(0)))), longer))).otherwise(person)
        if gender == "n":
            person = F.when((kind == "surname") & (part[0] == script), F.concat_ws("|", part[0], more)).otherwise(person)
    return (
        F.when(kind == "ip", octets).when(kind.isin("given", "surname"), person).when(kind == "card", F.concat(payload, luhn_digit(payload)))
        .when(kind == "iban", F.concat(F.substr(plain, F.lit(1), F.lit(2)), iban_digits(F.substr(plain, F.lit(1), F.lit(2)), account), account)).otherwise(plain)
    )


def laid_out(kind: Column, entity: Column, normal: Column) -> Column:
    """A surrogate's normal form in the spelling of the entity it stands for."""
    # walk over the entity: take the next surrogate character at each letter or digit, keep separators and case
    text = F.regexp_replace(normal, r"^\+", "")
    step = lambda acc, c: F.struct(
        (acc.n + c.rlike("^[0-9A-Za-z]$").cast("int")).alias("n"),
        F.concat(
            acc.out,
            F.when(~c.rlike("^[0-9A-Za-z]$"), c)
            .when(c.rlike("^[A-Z]$"), F.upper(F.substr(text, acc.n + 1, F.lit(1))))
            .when(c.rlike("^[a-z]$"), F.lower(F.substr(text, acc.n + 1, F.lit(1))))
            .otherwise(F.substr(text, acc.n + 1, F.lit(1))),
        ).alias("out"),
    )
    walked = F.aggregate(F.split(entity, ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("out")), step, lambda acc: acc.out)
    whole = F.zip_with(F.split(entity, ""), F.split(normal, ""), lambda a, b: F.when(a.rlike("^[A-Z]$"), F.upper(b)).otherwise(b))
    lettered = F.array_join(whole, "")
    capitals = F.when(entity.rlike("[A-Z]") & ~entity.rlike("[a-z]"), F.upper(lettered)).otherwise(lettered)
    return (
        F.when(kind.isin("given", "surname"), cased(entity, F.concat(F.element_at(F.split(normal, r"\|"), -1), F.when(kind == "surname", F.regexp_extract(F.lower(entity), SLAVIC, 2)).otherwise(""))))
        .when(kind == "ip", normal).when((kind == "secret") & entity.rlike(PREFIX), normal).when(kind.isin("email", "ip6"), lettered).when(kind == "secret", capitals).otherwise(walked)
    )


def cased(word: Column, surrogate_: Column) -> Column:
    return F.when((word == F.upper(word)) & (word != F.lower(word)), F.upper(surrogate_)).otherwise(F.initcap(surrogate_))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities: distinct (kind, normal). Adds ``stand_in``, unique in its kind and no entity itself."""
    entities = checkpointed(entities)
    at = entities.repartition(pieces(entities.count(), 4000), "kind", "normal").withColumn("attempt", F.lit(0))
    while True:
        drawn = at.withColumn("stand_in", surrogate(F.col("kind"), F.col("normal"), stream(key, F.col("kind"), F.col("normal"), F.col("attempt")), F.col("attempt")))
        rank = F.xxhash64("normal")
        keeper = drawn.groupBy("kind", "stand_in").agg(F.min(F.struct(rank.alias("h"), F.col("normal").alias("n"))).alias("k"))
        real = at.select(F.col("kind"), F.col("normal").alias("stand_in"), F.lit(True).alias("real"))
        judged = drawn.join(keeper, ["kind", "stand_in"]).join(real, ["kind", "stand_in"], "left")
        clash = F.col("real").isNotNull() | (F.col("k.n") != F.col("normal"))
        judged = checkpointed(judged.select("kind", "normal", "stand_in", "attempt", clash.alias("clash")))
        if not judged.where("clash").take(1):
            return judged.select("kind", "normal", "stand_in")
        at = checkpointed(judged.select("kind", "normal", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt")))


def heavy_keys(df: DataFrame, keys: list[str], count: Column | None = None) -> DataFrame:
    """Keys that hold more than one in 256 of the rows (and of 10,000): at most 256, whatever the data."""
    n = F.sum(F.lit(1) if count is None else count)
    counted = df.groupBy(*keys).agg(n.alias("_n"))
    total = counted.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("t")).first().t
    return counted.where(F.col("_n") > max(total / 256, 10_000)).select(*keys)


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which the hot keys of the left side meet their rows of the right side (one a key) by broadcast."""
    hot = F.broadcast(checkpointed(heavy_keys(left, keys)))
    many = left.join(hot, keys, "left_semi").join(F.broadcast(right.join(hot, keys, "left_semi")), keys, how)
    return left.join(hot, keys, "left_anti").join(right, keys, how).unionByName(many)


def name_atoms(seen: DataFrame) -> DataFrame:
    """Mentions of persons, word for word: (row, at, i, word, kind, normal). seen: (row, at, entity, kind)."""
    rest = F.regexp_replace("entity", rf"^{TITLE}", "")
    words = F.when(F.col("kind") == "name", F.regexp_extract_all(rest, F.lit(f"({WORD})"), F.lit(1))).otherwise(F.array("entity"))
    own = F.size(F.regexp_extract_all(F.regexp_extract(rest, r"(\S+)$", 1), F.lit(f"({WORD})"), F.lit(1)))  # words of the last, perhaps hyphened, name
    said = seen.where(F.col("kind").isNull() & F.col("entity").rlike(rf"^{WORD}$") | (F.col("kind") == "name"))
    said = said.select("row", "at", "kind", "entity", own.alias("own"), F.size(words).alias("n"), F.posexplode(words).alias("i", "word")).withColumn("low", F.lower("word"))

    titled = said.where("kind = 'name'").withColumn("last", F.col("i") >= F.col("n") - F.col("own"))
    full, man, woman = F.col("n") > F.col("own"), F.col("entity").rlike(rf"^(?:{TITLES_M})\.? "), F.col("entity").rlike(rf"^(?:{TITLES_F})\.? ")
    known = titled.groupBy("row", "low").agg(F.max(full & ~F.col("last")).alias("given"), F.max(full & F.col("last")).alias("family"), F.sum(man.cast("long")).alias("m"), F.sum(woman.cast("long")).alias("f"))
    gender = lambda m, f: F.when((m > 0) & (m >= f), "m").when(f > 0, "f")
    known = checkpointed(known.select("row", "low", (F.col("given") & ~F.col("family")).alias("given"), "m", "f", gender(F.col("m"), F.col("f")).alias("gender")))
    corpus = known.where("given").groupBy("low").agg(F.sum("m").alias("m"), F.sum("f").alias("f")).select("low", F.coalesce(gender(F.col("m"), F.col("f")), F.lit("n")).alias("usual"))
    unsure = joined(known.where("given AND gender IS NULL").drop("m", "f"), corpus, ["low"], "inner")
    known = known.where("NOT given OR gender IS NOT NULL").select("row", "low", "given", "gender").unionByName(unsure.select("row", "low", "given", F.col("usual").alias("gender")))

    low = F.col("low")
    stem = F.when(low.rlike(SLAVIC), F.regexp_extract(low, SLAVIC, 1)).otherwise(low)
    normal = F.when(F.col("given"), F.concat_ws("|", script_of(low), "gender", low)).otherwise(F.concat_ws("|", script_of(low), stem))
    found = said.drop("kind").join(known, ["row", "low"])
    return found.select("row", "at", "i", "word", F.when(F.col("given"), "given").otherwise("surname").alias("kind"), normal.alias("normal"))


def put_back(seen: DataFrame, key: str) -> DataFrame:
    """(row, s): for every match of a text, in order, its kind (null: not replaced) and what stands there now."""
    kind, entity = F.col("kind"), F.col("entity")
    others = seen.where("kind <> 'name'").select("row", "at", F.lit(0).alias("i"), entity.alias("word"), "kind", normal_form(kind, entity).alias("normal"))
    atoms = checkpointed(others.unionByName(name_atoms(seen)))
    table = surrogates(atoms.select("kind", "normal").distinct(), key)
    new = joined(atoms, table, ["kind", "normal"], "inner").select("row", "at", F.struct("i", laid_out(kind, F.col("word"), F.col("stand_in")).alias("new")).alias("a"))
    both = seen.select("row", "at", "entity", "kind", F.lit(None).cast("struct<i:int,new:string>").alias("a")).unionByName(new, allowMissingColumns=True)
    each = both.groupBy("row", "at").agg(F.max("entity").alias("entity"), F.max("kind").alias("kind"), F.array_sort(F.collect_list("a")).alias("a"))
    title = F.regexp_extract("entity", rf"^{TITLE}", 0)
    rest = F.regexp_replace("entity", rf"^{TITLE}", "")
    person = F.concat(title, F.array_join(F.zip_with(F.split(rest, WORD, -1), F.col("a.new"), lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), ""))
    told = F.when(F.size("a") == 0, entity).when(kind == "name", person).otherwise(F.col("a.new")[0])
    shown = F.when(F.size("a") > 0, F.coalesce(kind, F.lit("name")))
    return each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", shown.alias("kind"), told.alias("new")))).alias("s"))  # one document's own entities


def replace(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Replace every detected entity of every text; adds ``n_entities`` and ``kinds`` (kind of each, in order)."""
    names = own_names(df, "row", "salt", "s", "named")
    row, salt, s, named = (F.col(names[k]) for k in ("row", "salt", "s", "named"))
    text = F.col(f"`{text_col}`")
    d = df.drop("n_entities", "kinds")
    likely = F.coalesce(text.rlike(LIKELY), F.lit(False))

    every = lambda pattern: F.regexp_extract_all("t", F.lit(f"({pattern})"), F.lit(1))
    is_name = lambda e: e.rlike(rf"^{TITLE}")
    hits = d.where(likely).select(text.alias("t")).withColumn("f", every(ANY)).withColumn("named", F.exists("f", is_name))
    hits = hits.select(F.md5("t").alias("row"), "named", F.when(F.col("named"), every(ANY_WORD)).otherwise(F.col("f")).alias("f"))
    hits = checkpointed(hits.groupBy("row").agg(F.first("named").alias("named"), F.first("f").alias("f"), F.count(F.lit(1)).alias("n")).where(F.size("f") > 0))
    spread = hits.repartition(pieces(hits.count(), 1000), "row")
    seen = checkpointed(spread.select("row", F.posexplode("f").alias("at", "entity")).withColumn("kind", type_of(F.col("entity"))))
    done = put_back(seen, key).join(hits.select("row", "named"), "row")

    # back to the texts, hot ones salted
    hot = [r.row for r in heavy_keys(hits, ["row"], F.col("n")).collect()]
    salts = 64 if hot else 1
    is_hot = lambda c: c.isin(hot) if hot else F.lit(False)
    done = done.withColumn("salt", F.explode(F.when(is_hot(F.col("row")), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    done = done.select(F.col("row").alias(names["row"]), F.col("salt").alias(names["salt"]), F.col("s").alias(names["s"]), F.col("named").alias(names["named"]))
    some = d.where(likely).withColumn(names["row"], F.md5(text))
    some = some.withColumn(names["salt"], F.when(is_hot(row), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).otherwise(0))
    both = some.join(done, [names["row"], names["salt"]], "left")
    gaps = F.when(named, F.split(text, ANY_WORD, -1)).otherwise(F.split(text, ANY, -1))
    told = F.array_join(F.zip_with(gaps, s["new"], lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")
    kinds = F.filter(s["kind"], lambda k: k.isNotNull())
    none = {"n_entities": F.lit(0).cast("long"), "kinds": F.array().cast("array<string>")}
    changed = {text_col: F.when(s.isNotNull(), told).otherwise(text), "n_entities": F.when(s.isNotNull(), F.size(kinds).cast("long")).otherwise(none["n_entities"]), "kinds": F.coalesce(kinds, none["kinds"])}
    return both.withColumns(changed).drop(*names.values()).unionByName(d.where(~likely).withColumns(none))
