"""Personal data replaced by keyed surrogates of the same kind, gender, script and format.

One pattern finds e-mail and IP addresses (of both versions), bank accounts, phone,
card and social security numbers, long hexadecimal tokens and names after a title.
What stands for an entity is decided once for the whole corpus, on its normal form:
digits for numbers, lower case for addresses and tokens, and single words for names,
so "Mrs. Ana Ruiz" and "Frau Ruiz" keep pointing at one person. A name that a title
tells once in a text is also replaced where its words stand bare in that text, as
written or in capitals. A surrogate comes
from sha2(key, kind, entity, attempt). Surrogates that two entities would share,
or that are entities of the corpus themselves, are drawn again for all but the
first, until all are distinct. Later draws widen what can grow: host labels of
addresses, syllables of names. What short numbers are left after ATTEMPTS draws
is numbered through the free values of their length. Each spelling is then written in its own format:
digits go into the places of digits, upper case stays upper case.

Formats kept: the local part's classes of characters and its case, and the number of
labels of an address (hosts become reserved example names), four octets or eight
groups in the prefix reserved for documentation, the country, grouping and check
digits of an account, the first
digit and the check digit of cards that pass the Luhn test, the first digit of
numbers after "+", lengths everywhere. Given names keep the gender their title
tells and their script, Latin or Cyrillic.

All of it is DataFrame functions. Entities are a table joined by a shuffle, not
held on the driver; texts without any entity pass without a shuffle. Nulls: a
null text stays null with 0 entities. Repeated rows are rewritten alike; rows
with a null doc_id are rewritten. An empty table gives no rows; other columns
are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

OCTET = "(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)"
#: kind -> pattern; earlier kinds win where two would match at one place.
KINDS = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}",
    "ip": f"(?<![\\w.]){OCTET}(?:\\.{OCTET}){{3}}(?![\\w]|\\.\\d)",
    "ip6": "(?<![\\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\\w:])",
    "token": "(?<!\\w)(?=[0-9a-fA-F]*[a-fA-F])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?!\\w)",
    "iban": "(?<!\\w)[A-Z]{2}\\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\\w)",
    "card": "(?<!\\w)(?:\\d{13,19}|\\d{4}(?:[ -]\\d{4}){3})(?!\\w)",
    "ssn": "(?<![\\w-])\\d{3}-\\d{2}-\\d{4}(?![\\w-])",
    "phone": "\\+\\d{1,3}[ .-]?\\(?\\d{2,4}\\)?(?:[ .-]?\\d{2,4}){1,4}(?!\\w)|(?<![\\w(])\\(\\d{3}\\) ?\\d{3}[ -]\\d{4}(?!\\w)|(?<![\\w-])\\d{3}-\\d{3}-\\d{4}(?![\\w-])",
    "name": "(?<!\\p{L})(?:Mrs|Mr|Ms|Miss|Herr|Frau|Señora|Señor|Sra|Sr|Monsieur|Madame|Mme|Господин|Госпожа|господин|госпожа)\\.? \\p{Lu}[\\p{L}'’-]+(?: \\p{Lu}[\\p{L}'’-]+)?",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Every entity holds one of these: texts that don't are passed on without trying the pattern.
QUICK = "[@0-9]|::|(?:Mr|Ms|Miss|Herr|Frau|Señor|Sr|Monsieur|Madame|Mme|[Гг]оспо)"
FEMALE, MALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа", "госпожа"], ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин", "господин"]
#: Syllables of made-up names.
LATIN = [a + b for a in ("b", "d", "f", "k", "l", "m", "n", "r", "s", "t", "v", "z") for b in ("a", "e", "i", "o")]
CYRILLIC = [a + b for a in ("б", "д", "к", "л", "м", "н", "р", "с", "т", "в", "з", "г") for b in ("а", "е", "и", "о")]
ENDINGS = {"given_f": ("na", "на"), "given_m": ("rik", "рик"), "surname": ("sen", "сен"), "given_u": ("li", "ли")}
ATTEMPTS = 32
#: Every so many attempts, draws get one label or syllable more.
WIDEN = 4
#: Numbers of up to so many digits are numbered through if draws don't end; there are too many longer ones to use up.
SHORT = 9


def _kind(raw: Column) -> Column:
    tests = [F.when(raw.rlike("@"), "email"), F.when(raw.rlike(f"^(?:{KINDS['ip']})$"), "ip"), F.when(raw.rlike("^[0-9A-Fa-f]{1,4}:"), "ip6"), F.when(raw.rlike("^\\p{L}+\\.? \\p{Lu}"), "name"), F.when(raw.rlike("^[0-9a-fA-F]{32,128}$") & raw.rlike("[a-fA-F]"), "token"), F.when(raw.rlike(f"^(?:{KINDS['iban']})$"), "iban"), F.when(raw.rlike("^\\d{3}-\\d{2}-\\d{4}$"), "ssn"), F.when(raw.rlike("^\\d[\\d -]{12,18}$"), "card")]
    return F.coalesce(*tests, F.lit("phone"))


def _parts(raw: Column, kind: Column) -> Column:
    """[(kind, normal form)] of a spelling: one, but for names with a given name."""
    part = lambda k, n: F.struct(k.alias("kind"), n.alias("norm"))
    spaced = F.split(raw, " ")
    title = F.regexp_replace(spaced[0], "\\.$", "")
    given = F.when(title.isin(FEMALE), "given_f").when(title.isin(MALE), "given_m").otherwise("given_u")
    name = F.when(F.size(spaced) == 3, F.array(part(given, F.lower(F.get(spaced, F.lit(1)))), part(F.lit("surname"), F.lower(F.get(spaced, F.lit(2)))))).otherwise(F.array(part(F.lit("surname"), F.lower(F.get(spaced, F.lit(1))))))
    plain = F.when(kind.isin("card", "ssn", "phone"), F.regexp_replace(raw, "\\D", "")).otherwise(F.lower(raw))
    plain = F.when(kind == "iban", F.replace(raw, F.lit(" "), F.lit(""))).otherwise(plain)
    return F.when(kind == "name", name).otherwise(F.array(part(kind, plain)))


def _byte(stream: Column, i: Column) -> Column:
    """The i-th (from 0) byte of a hexadecimal stream."""
    return F.conv(F.substring(stream, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _redrawn(text: Column, stream: Column, skip: int = 0) -> Column:
    """text with each digit and small letter after the first `skip` characters drawn from the stream; others stay."""

    def one(c: Column, i: Column) -> Column:
        drawn = F.when(c.rlike("[0-9]"), (_byte(stream, i) % 10).cast("string")).when(c.rlike("[a-z]"), F.char(_byte(stream, i) % 26 + 97)).otherwise(c)
        return F.when(i < skip, c).otherwise(drawn) if skip else drawn

    return F.array_join(F.transform(_chars(text), one), "")


def _luhn(digits: Column) -> Column:
    """The sum of the Luhn test over all digits, the last of them a check digit."""
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * (F.lit(1) + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.reverse(_chars(digits)), value), F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of a text of digits and capitals, a capital counting 10 to 35."""
    def add(rest: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n < 65, (rest * 10 + n - 48) % 97).otherwise((rest * 100 + n - 55) % 97)

    return F.aggregate(_chars(text), F.lit(0), lambda rest, c: add(rest, c).cast("int"))


def _account(norm: Column, stream: Column) -> Column:
    """An account of the same country, each digit and capital drawn anew, with check digits that hold."""
    body = F.lower(F.substring(norm, F.lit(5), F.length(norm) - 4))
    drawn, country = F.upper(_redrawn(body, stream)), F.substring(norm, 1, 2)
    check = F.lit(98) - _mod97(F.concat(drawn, country, F.lit("00")))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), drawn)


def _surrogate(kind: Column, norm: Column, key: str, attempt: int) -> Column:
    seed = F.concat_ws("\x1f", F.lit(key), kind, norm, F.lit(str(attempt)))
    wide = min(attempt // WIDEN, 12)  # 64 bytes of the stream last for so many labels
    blocks = F.sequence(F.lit(0), F.floor(F.length(norm) / 32).cast("int") + 1)
    stream = F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("\x1f", seed, b.cast("string")), 256)), "")
    local, labels = F.split(norm, "@")[0], F.size(F.split(F.get(F.split(norm, "@"), F.lit(1)), "\\."))
    host = F.concat(F.when(labels > 2, F.concat(F.repeat(F.lit("m."), labels - 3), F.lit("h"), (_byte(stream, F.lit(30)) * 256 + _byte(stream, F.lit(31))).cast("string"), F.lit("."))).otherwise(F.lit("")), F.lit("example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), _byte(stream, F.lit(29)) % 3 + 1))
    more = [F.concat(F.lit("h"), (_byte(stream, F.lit(32 + 2 * i)) * 256 + _byte(stream, F.lit(33 + 2 * i))).cast("string"), F.lit(".")) for i in range(wide)]
    email = F.concat(_redrawn(local, stream), F.lit("@"), *more, host)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(stream, i) % 254 + 1).cast("string")), ".")
    groups = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.lower(F.conv(F.substring(stream, i * 4 + 1, F.lit(4)), 16, 16)))
    ip6 = F.concat(F.lit("2001:db8:"), F.array_join(groups, ":"))
    hexed = F.substring(stream, F.lit(1), F.length(norm))
    token = F.when(hexed.rlike("[a-f]"), hexed).otherwise(F.concat(F.lit("a"), F.substring(hexed, F.lit(2), F.length(norm) - 1)))
    number = _redrawn(norm, stream, 1)
    body = F.substring(number, F.lit(1), F.length(norm) - 1)
    check = (F.lit(10) - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.when(_luhn(norm) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(number)
    cyrillic = norm.rlike("\\p{IsCyrillic}")

    def name(k: str) -> Column:
        made = lambda syllables, end: F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.least(F.lit(4), F.floor(F.length(norm) / 4)).cast("int") + 1 + wide), lambda i: F.element_at(F.array(*map(F.lit, syllables)), _byte(stream, i) % len(syllables) + 1)), ""), F.lit(end))
        return F.when(cyrillic, made(CYRILLIC, ENDINGS[k][1])).otherwise(made(LATIN, ENDINGS[k][0]))

    drawn = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "token", token).when(kind == "card", card)
    drawn = drawn.when(kind == "ip6", ip6).when(kind == "iban", _account(norm, stream))
    for k in ENDINGS:
        drawn = drawn.when(kind == k, name(k))
    return drawn.otherwise(number)


def _numbered(pending: DataFrame, taken: DataFrame, first_kept: bool) -> DataFrame:
    """(kind, norm, surrogate): pending numbers in order beside the numbers of their length (and first digit) that aren't taken."""
    spark = pending.sparkSession
    head = F.substring("norm", 1, 1) if first_kept else F.lit("")
    asked = pending.withColumn("head", head).withColumn("rest", F.length("norm") - F.length("head"))
    free = None
    for digits in sorted(r["rest"] for r in asked.select("rest").distinct().collect()):
        groups = F.broadcast(asked.where(F.col("rest") == digits).select("kind", "head", "rest").distinct())
        some = spark.range(10**digits).select(F.lpad(F.col("id").cast("string"), digits, "0").alias("tail")).crossJoin(groups).select("kind", "head", "rest", F.concat("head", "tail").alias("surrogate"))
        free = some if free is None else free.unionByName(some)
    free = free.join(taken, ["kind", "surrogate"], "left_anti")
    place = ["kind", "head", "rest"]
    free = free.withColumn("nth", F.row_number().over(W.partitionBy(*place).orderBy(F.xxhash64("surrogate"), "surrogate")))
    asked = asked.withColumn("nth", F.row_number().over(W.partitionBy(*place).orderBy("norm")))
    return asked.join(free, [*place, "nth"]).select("kind", "norm", "surrogate")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) for distinct (kind, norm): surrogates of a kind are distinct and none is an entity."""
    real = entities.select("kind", F.col("norm").alias("surrogate"))
    done, pending = None, entities
    attempt = 0
    while True:
        drawn = pending.withColumn("surrogate", _surrogate(F.col("kind"), F.col("norm"), key, attempt))
        free = drawn.join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        first = free.withColumn("nth", F.row_number().over(W.partitionBy("kind", "surrogate").orderBy("norm"))).where("nth = 1").select("kind", "norm", "surrogate")
        kept = written(first, "surrogates")
        done = kept if done is None else done.unionByName(kept)
        pending = written(pending.join(kept.select("kind", "norm"), ["kind", "norm"], "left_anti"), "pending")
        if pending.isEmpty():
            return done
        attempt += 1
        short = F.col("kind").isin("phone", "ssn") & (F.length("norm") <= SHORT)
        for first_kept in (True, False) if attempt == ATTEMPTS else ():
            if (left := pending.where(short)).isEmpty():
                break
            kept = written(_numbered(left, real.unionByName(done.select("kind", "surrogate")), first_kept), "surrogates")
            done = done.unionByName(kept)
            pending = written(pending.join(kept.select("kind", "norm"), ["kind", "norm"], "left_anti"), "pending")
        if attempt >= ATTEMPTS and not (left := pending.where(short)).isEmpty():
            raise ValueError(f"{left.count()} numbers have no distinct surrogate: the corpus holds more than half of all numbers of their length")
        if pending.isEmpty():
            return done


def _spelled(raw: Column, kind: Column, found: Column) -> Column:
    """The surrogate(s) in the format of a spelling. found: the surrogates of its parts, in order."""
    one = found[0]
    digit_at = F.transform(_chars(raw), lambda c, i: F.when(c.rlike("\\d"), F.length(F.regexp_replace(F.substring(raw, F.lit(1), i + 1), "\\D", ""))).otherwise(0))
    digits = F.array_join(F.zip_with(_chars(raw), digit_at, lambda c, n: F.when(n > 0, F.substring(one, n, F.lit(1))).otherwise(c)), "")
    upper = F.when((raw == F.upper(raw)) & (raw != F.lower(raw)), F.upper(one)).otherwise(one)
    local, new_local = F.split(raw, "@")[0], F.split(one, "@")[0]
    cased = F.array_join(F.zip_with(_chars(local), _chars(new_local), lambda c, n: F.when(c != F.lower(c), F.upper(n)).otherwise(n)), "")
    email = F.when(raw == F.upper(raw), F.upper(one)).otherwise(F.concat(cased, F.substring(one, F.length(new_local) + 1, F.length(one))))
    held = F.transform(_chars(raw), lambda c, i: F.when(c == " ", 0).otherwise(F.length(F.replace(F.substring(raw, F.lit(1), i + 1), F.lit(" "), F.lit("")))))
    account = F.array_join(F.zip_with(_chars(raw), held, lambda c, n: F.when(n > 0, F.substring(one, n, F.lit(1))).otherwise(c)), "")
    shaped = lambda word, new: F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(new)).otherwise(F.initcap(new))
    spaced = F.split(raw, " ")
    name = F.concat_ws(" ", F.array(spaced[0]), F.zip_with(F.slice(spaced, 2, 2), found, shaped))
    return F.when(kind == "name", name).when(kind.isin("card", "ssn", "phone"), digits).when(kind == "email", email).when(kind == "iban", account).otherwise(upper)


def _bare(gap: Column, names: Column) -> Column:
    """A stretch of text with the words of names, (word, new) each, replaced where they stand alone."""
    def one(text: Column, name: Column) -> Column:
        return F.regexp_replace(text, F.concat(F.lit("(?<![\\p{L}\\p{N}])\\Q"), name["word"], F.lit("\\E(?![\\p{L}\\p{N}])")), name["new"])

    return F.when(F.size(names) > 0, F.aggregate(names, gap, one)).otherwise(gap)


def _words(raw: Column, new: Column) -> Column:
    """(word, new) of a name's words after its title, as written and in capitals."""
    after = lambda c: F.slice(F.split(c, " "), 2, 2)
    pair = lambda w, n: F.struct(w.alias("word"), n.alias("new"))
    plain = F.zip_with(after(raw), after(new), pair)
    return F.concat(plain, F.transform(plain, lambda p: pair(F.upper(p["word"]), F.upper(p["new"]))))


#: Rows that hold one spelling: from so many on it is joined apart, by a broadcast of the few such spellings.
HOT = 20_000


def _by_row(raws: DataFrame, spelled: DataFrame) -> DataFrame:
    """(row, raw, new, name): raws (row, raw) with what stands for them. A spelling that very many rows hold meets them where they are."""
    total = raws.count()
    least = max(HOT, total // 2000)
    hot = written(raws.groupBy("raw").count().where(F.col("count") >= least).select("raw"), "hot")
    if total < HOT or hot.isEmpty():
        return raws.join(spelled, "raw")
    few = written(spelled.join(F.broadcast(hot), "raw", "left_semi"), "hot")  # at most 2000 spellings
    rest = raws.join(F.broadcast(hot), "raw", "left_anti").join(spelled, "raw")
    return rest.unionByName(raws.join(F.broadcast(few), "raw"))


def replace(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_entities) of every row of docs (doc_id, text), the text with its entities replaced."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    tried = plain.withColumn("found", F.when(F.col("text").rlike(QUICK), found).otherwise(F.array().cast("array<string>")))
    some = written(tried.where(F.size("found") > 0).withColumn("row", F.xxhash64("doc_id", "text")), "some")
    raws = written(some.select("row", F.explode(F.array_distinct("found")).alias("raw")).distinct(), "entities")
    kinds = written(raws.select("raw").distinct().withColumn("kind", _kind(F.col("raw"))).withColumn("parts", _parts(F.col("raw"), F.col("kind"))), "kinds")
    names = assign(written(kinds.select(F.explode("parts").alias("p")).select("p.kind", "p.norm").distinct(), "names"), key)
    parts = kinds.select("raw", "kind", F.posexplode("parts").alias("i", "p")).select("raw", F.col("kind").alias("of"), "i", "p.kind", "p.norm").join(names, ["kind", "norm"])
    spelled = parts.groupBy("raw", "of").agg(F.sort_array(F.collect_list(F.struct("i", "surrogate"))).alias("s"))
    spelled = written(spelled.select("raw", _spelled(F.col("raw"), F.col("of"), F.col("s.surrogate")).alias("new"), (F.col("of") == "name").alias("name")), "spelled")
    bare = F.flatten(F.collect_set(F.when(F.col("name"), _words(F.col("raw"), F.col("new")))))
    maps = _by_row(raws, spelled).groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("raw", "new"))).alias("new"), F.array_distinct(bare).alias("bare"))
    joined = some.join(maps, "row")
    gaps = F.transform(F.split("text", PATTERN, -1), lambda gap: _bare(gap, F.col("bare")))
    joined = joined.withColumn("gaps", gaps)
    text = F.concat(F.array_join(F.transform("found", lambda e, i: F.concat(F.get(F.col("gaps"), i), F.element_at(F.col("new"), e))), ""), F.element_at("gaps", -1))
    rewritten = joined.select("doc_id", text.alias("text"), F.size("found").cast("long").alias("n_entities"))
    return tried.where((F.size("found") == 0) | F.col("text").isNull()).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities")).unionByName(rewritten)
