"""Secrets in texts: three fixed patterns, and tokens that a battery of randomness tests finds. DataFrame functions only.

Tokens of letters, digits and ``+/_=-`` are read in the alphabet that they seem to be encoded in (hex, base32, base64). Three tests ask how far the token is from uniform random symbols: chi-squared over the alphabet, runs about its middle, and serial correlation of neighbours. Fisher's method joins the three. Natural tokens are those without digits, and names made of the corpus's own words: all prose of all documents is cut into names one after the other, each neighbouring words behind a number or date; the length classes take turns, each with names of its least length. How often natural tokens of a class look as random gives an empirical p-value for the tokens with digits, and the Benjamini-Hochberg rule picks, per length class, those that stand out at false-discovery rate ``rate``. All counts run over all documents. Names are many: their bins come from counts of bits (``_name_bins``). One secret stands out of N tokens of its class where the corpus has N / ``rate`` names of that class: one in about 250 characters of prose.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Fixed patterns: kind, pattern, group whose length counts, least length.
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),  # a shorter run of these characters holds no longer match
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
KINDS = ("assign", "access", "hex", "random")
_TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
_HEX, _BASE32 = "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_BINS, _BIN = 200, 0.1
_STRETCH = 1000
#: The longest length class has all tokens of at least its least length: the longer a name, the less random it looks.
_FIRST_CLASS, _LAST_CLASS = 13, 19
_LEAST = {k: max(20, math.ceil(1.25**k)) for k in range(_FIRST_CLASS, _LAST_CLASS + 1)}


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, kind, end, body>> of the matches: the pieces between them give their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    cells = _let(found, lambda x: F.arrays_zip(x.alias("found"), F.slice(F.split(text, pattern), 1, F.size(x)).alias("part"), (bodies if group else x).alias("body")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:string,end:int,body:string>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["part"])
        end = start + F.length(x["found"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["body"].alias("body"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    spans = F.aggregate(cells, zero, add, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), F.filter(spans, lambda s: F.length(s["body"]) >= least)).otherwise(F.array().cast("array<struct<start:int,kind:string,end:int,body:string>>"))


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal law (Zelen and Severo's polynomial, error below 1e-7)."""
    x = F.abs(z)
    poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * _let(1 / (1 + 0.2316419 * x), poly)
    return _let(tail, lambda y: F.when(z >= 0, y).otherwise(1 - y))


def _ln_p(p: Column) -> Column:
    return F.ln(F.greatest(p, F.lit(1e-12)))


def _codes(alphabet: str, alike: dict[str, str]) -> list[int]:
    """For each ASCII code the place of its symbol in ``alphabet``, doubled and counted from the middle: never 0, below it in the lower half."""
    return [2 * alphabet.index(c) + 1 - len(alphabet) if (c := alike.get(chr(k), chr(k))) in alphabet else 0 for k in range(128)]


_TABLES = {
    "hex": (len(_HEX), _codes(_HEX, {c: c.upper() for c in "abcdef"})),
    "base32": (len(_BASE32), _codes(_BASE32, {})),
    "base64": (len(_BASE64), _codes(_BASE64, {"-": "+", "_": "/"})),
}


def _by_alphabet(token: Column, of: dict[str, Column]) -> Column:
    """``of`` the alphabet that ``token`` seems to be encoded in."""
    return F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), of["hex"]).when(token.rlike("^[A-Z2-7]+$"), of["base32"]).otherwise(of["base64"])


def randomness(token: Column) -> Column:
    """Fisher's p-value that ``token`` is uniform random in the alphabet it seems to be encoded in."""
    bare = F.rtrim(token, F.lit("="))
    kinds = {name: F.struct(F.lit(size).alias("a"), F.array(*map(F.lit, codes)).alias("codes")) for name, (size, codes) in _TABLES.items()}
    # '=' inside a token belongs to no alphabet: such symbols are left out
    symbols = F.split(F.replace(bare, F.lit("=")), "")
    coded = _let(_by_alphabet(bare, kinds), lambda x: F.struct(x["a"].alias("a"), F.filter(F.transform(symbols, lambda c: F.get(x["codes"], F.ascii(c))), lambda u: u != 0).alias("codes")))
    return _let(coded, lambda x: _battery(x["codes"], x["a"]))


def _battery(codes: Column, symbols: Column) -> Column:
    """Fisher's p-value of three tests. ``codes`` are odd numbers about the middle of an alphabet of ``symbols``."""
    size = F.size(codes)
    squares = F.aggregate(F.array_distinct(codes), F.lit(0), lambda acc, k: acc + _let(size - F.size(F.array_remove(codes, k)), lambda c: c * c))
    pairs = F.greatest(size - 1, F.lit(0))
    products = F.zip_with(F.slice(codes, F.lit(1), pairs), F.slice(codes, F.lit(2), pairs), lambda u, v: u * v)
    sums = lambda p: F.struct(size.alias("n"), squares.alias("squares"), F.size(F.filter(p, lambda x: x < 0)).alias("turns"), F.aggregate(p, F.lit(0), lambda acc, x: acc + x).alias("serial"))
    return _let(_let(products, sums), lambda x: _fisher(x["n"], symbols, x["squares"], x["turns"], x["serial"]))


def _fisher(size: Column, symbols: Column, squares: Column, turns: Column, serial: Column) -> Column:
    """Fisher's p-value of chi-squared, runs and serial correlation of ``size`` symbols: the sum of their counts' ``squares``, the ``turns`` between halves of the alphabet, the sum of neighbours' products."""
    a, n = symbols.cast("double"), F.greatest(size, F.lit(2)).cast("double")
    chi = a / n * squares - n
    z_chi = (chi - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
    z_runs = (turns.cast("double") - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    z_serial = serial / 4 / ((a * a - 1) / 12) / F.sqrt(n - 1)
    logs = _let(z_chi, lambda z: _ln_p(_normal_tail(z))) + _let(F.abs(z_runs), lambda z: _ln_p(2 * _normal_tail(z))) + _let(F.abs(z_serial), lambda z: _ln_p(2 * _normal_tail(z)))
    # Fisher: upper tail of chi-squared with six degrees of freedom
    return F.when(n >= 8, _let(-logs, lambda y: F.exp(-y) * (1 + y + y * y / 2))).otherwise(F.lit(0.0))


#: Symbols of six bits each, the top bit says in which half of the alphabet; a seventh is set where there is a symbol.
_BITS = 6


def _spelled(name: Column) -> Column:
    """``name`` with its symbols replaced by characters that have their places in the alphabet as last six bits, scaled to 64 places, and the bit above these set."""
    coded = {}
    for kind, (size, codes) in _TABLES.items():
        known = {chr(k): chr((1 << _BITS) + (u + size - 1) // 2 * (64 // size)) for k, u in enumerate(codes) if u}
        coded[kind] = F.translate(name, "".join(known), "".join(known.values()))
    return _by_alphabet(name, coded)


def _step(df: DataFrame, *more: Column) -> DataFrame:
    """``df`` with columns ``more``, behind a generator of one row: Spark's code for a step is then a method of its own, small enough to be compiled by the JVM (8,000 bytes)."""
    df = df.select("*", *more)
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _name_bins(names: DataFrame) -> DataFrame:
    """class, bin of names (class, text), as ``_bin_of`` gives them, by columns of bits: names are many, have 72 symbols at most and no '='.

    Bit b of the first 64 symbols is column ``p<b>``, that of the others ``q<b>``: symbol 8 j + k has bit 8 (7 - k) + j of p, symbol 64 + k has bit 8 (7 - k) of q. Symbols that are alike and neighbours that differ are then found for all places at once.
    """
    bits = range(_BITS + 1)
    sizes = {kind: F.lit(size) for kind, (size, _) in _TABLES.items()}
    spelled = names.select("class", _by_alphabet(F.col("text"), sizes).alias("a"), F.rpad(_spelled(F.col("text")), 72, "\0").alias("spelled"))
    words = _step(spelled, *(F.coalesce(F.conv(F.hex(F.substring("spelled", 8 * j + 1, 8)), 16, 10).cast("long"), F.lit(0)).alias(f"w{j}") for j in range(9))).drop("spelled")
    bit = lambda j, b: F.shiftright(f"w{j}", b).bitwiseAND(F.lit(0x0101010101010101))
    first = [functools.reduce(Column.bitwiseOR, (F.shiftleft(bit(j, b), j) for j in range(8))).alias(f"p{b}") for b in bits]
    planes = _step(words, *first, *(bit(8, b).alias(f"q{b}") for b in bits)).drop(*(f"w{j}" for j in range(9)))
    plane = [(F.col(f"p{b}"), F.col(f"q{b}")) for b in bits]
    both = lambda u, v: tuple(x.bitwiseAND(y) for x, y in zip(u, v))
    less = lambda u, v: tuple(x.bitwiseAND(F.bitwise_not(y)) for x, y in zip(u, v))
    count = lambda u: F.bit_count(u[0]) + F.bit_count(u[1])
    total = lambda cells: functools.reduce(operator.add, cells)
    here, upper = plane[_BITS], plane[_BITS - 1]

    def squares(held: tuple[Column, Column], b: int) -> Column:
        """The sum of the squared counts of the symbols in ``held``, which are alike from bit ``b`` on."""
        if not b:
            return count(held) * count(held)
        return squares(both(held, plane[b - 1]), b - 1) + squares(less(held, plane[b - 1]), b - 1)

    counted = _step(planes, squares(both(here, upper), _BITS - 1).alias("squares_upper"))
    counted = _step(counted, squares(less(here, upper), _BITS - 1).alias("squares_lower"))
    # the bit of each symbol's right neighbour, at the symbol's place
    ahead = lambda p, q: (F.shiftleft(p, 8).bitwiseOR(F.shiftrightunsigned(p, 57)).bitwiseOR(F.shiftrightunsigned(q, 49)), F.shiftleft(q, 8))
    counted = _step(counted, *(x.alias(f"{name}{b}") for b in bits for name, x in zip("xy", ahead(*plane[b]))))
    right = [(F.col(f"x{b}"), F.col(f"y{b}")) for b in bits]
    counted = _step(counted, total([F.lit(1 << i + j) * count(both(plane[i], right[j])) for i in range(_BITS) for j in range(_BITS)]).alias("products"))
    counted = counted.select(
        "class",
        "a",
        count(here).alias("n"),
        (F.col("squares_upper") + F.col("squares_lower")).alias("squares"),
        (count(less(right[_BITS], both(upper, right[_BITS - 1]))) - count(less(less(right[_BITS], upper), right[_BITS - 1]))).alias("turns"),
        "products",
        total([F.lit(1 << b) * (count(both(right[_BITS], plane[b])) + count(right[b])) for b in range(_BITS)]).alias("sums"),
    )
    # places are scaled to 64: twice a place, less the middle, is what _codes has, times the scale
    scale = 64 / F.col("a")
    middle = scale - 64
    serial = (4 * F.col("products") + 2 * middle * F.col("sums") + middle * middle * F.greatest(F.col("n") - 1, F.lit(0))) / scale / scale
    return counted.select("class", _bin(_fisher(F.col("n"), F.col("a"), F.col("squares"), F.col("turns"), serial)).alias("bin"))


def _class_of(length: Column) -> Column:
    """Length classes of about a factor 1.25."""
    return F.least(F.floor(F.log(1.25, length.cast("double"))).cast("int"), F.lit(_LAST_CLASS))


def _bin(p: Column) -> Column:
    return F.least(F.lit(_BINS), F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) / _BIN)).cast("int")


def _bin_of(token: Column) -> Column:
    return _bin(randomness(token))


def _prose(text: Column) -> Column:
    """The words of ``text``, joined by spaces. Only whole words of under 20 characters are used, so that no part of a secret counts as natural."""
    # each long word with the blank before it, so that no pattern is tried inside words
    short = F.regexp_replace(F.concat(F.lit(" "), text), r"\s\S{20,}", " ")
    return F.trim(F.regexp_replace(short, r"\P{Alnum}+", " "))


def _stretches(text: Column) -> Column:
    """The prose of ``text`` in pieces; an end too short for a name stays with the piece before it."""
    return F.regexp_extract_all(_prose(text), F.lit(f".{{1,{_STRETCH}}}(?:.{{1,20}}$)?"), F.lit(0))


def _cuts(length: Column, behind: Column, turn: Column) -> Column:
    """array<struct<class, at, n>>: names of ``n`` characters from place ``at`` on that cover ``length`` characters of words, each behind a number of ``behind`` characters. The classes that fit take turns, beginning at one given by ``turn``; the last name ends where the words do."""
    sums = [sum(list(_LEAST.values())[:k]) for k in range(len(_LEAST) + 1)]
    classes = F.array(*(F.struct(F.lit(k).alias("class"), F.lit(n).alias("n"), F.lit(j).alias("j"), F.lit(sums[j]).alias("sum")) for j, (k, n) in enumerate(_LEAST.items())))
    place = lambda x: x["sum"] - x["j"] * behind

    def of_round(fits: Column, whole: Column, begin: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.floor((length - 1) / whole).cast("int"))
        every = F.flatten(F.transform(rounds, lambda r: F.transform(fits, lambda x: F.struct(x["class"].alias("class"), (r * whole + F.pmod(place(x) - begin, whole)).alias("at"), (x["n"] - behind).alias("n")))))
        return F.transform(F.filter(every, lambda x: x["at"] < length), lambda x: F.struct(x["class"].alias("class"), F.least(x["at"], length - x["n"]).alias("at"), x["n"].alias("n")))

    def of_classes(fits: Column) -> Column:
        last, first = F.element_at(fits, -1), F.get(fits, F.pmod(turn, F.size(fits)).cast("int"))
        plan = F.struct((place(last) + last["n"] - behind).alias("whole"), place(first).alias("begin"))
        return F.when(F.size(fits) > 0, _let(plan, lambda x: of_round(fits, x["whole"], x["begin"])))

    return F.coalesce(_let(F.filter(classes, lambda x: x["n"] - behind <= length), of_classes), F.array().cast("array<struct<class:int,at:int,n:int>>"))


def _names(stretch: Column) -> Column:
    """array<struct<class, text>>: names that all words of ``stretch`` are cut into."""
    key = F.xxhash64(stretch)
    bits = lambda at, n: F.pmod(F.shiftrightunsigned(key, at), F.lit(n)).cast("int")
    styled = F.struct(
        F.element_at(F.array(*map(F.lit, ("-", "_", "/", ""))), bits(0, 4) + 1).alias("glue"),
        (bits(2, 4) == 0).alias("date"),
        (bits(4, 4) + 1).alias("digits"),
        F.when(bits(7, 2) == 0, F.initcap(stretch)).otherwise(stretch).alias("words"),
        F.shiftrightunsigned(key, 8).alias("turn"),
    )

    def of_style(x: Column) -> Column:
        glue = x["glue"]
        behind = F.when(x["date"], 8 + 2 * F.length(glue)).otherwise(x["digits"]) + F.length(glue)
        plan = F.struct(F.replace(x["words"], F.lit(" "), glue).alias("words"), behind.alias("behind"))

        def name(words: Column, cut: Column) -> Column:
            digits = lambda number, at, n: F.lpad(F.pmod(F.shiftrightunsigned(number, at), F.lit(10**n)).cast("string"), n, "0")
            front = lambda number: F.when(x["date"], F.concat(digits(number, 8, 4), glue, digits(number, 24, 2), glue, digits(number, 40, 2))).otherwise(F.substring(digits(number, 8, 4), F.lit(1), x["digits"]))
            return F.concat(_let(F.xxhash64(words, cut["at"]), front), glue, F.substring(words, cut["at"] + 1, cut["n"]))

        return _let(plan, lambda y: F.transform(_cuts(F.length(y["words"]), y["behind"], x["turn"]), lambda cut: F.struct(cut["class"].alias("class"), name(y["words"], cut).alias("text"))))

    return _let(styled, of_style)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with base (array of spans), tokens (array of start, end, class, bin, natural) and names (array of class, text): bins count tenths of -log10 of the p-value, so that 0 looks most random."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.withColumn("base", F.array_sort(F.concat(*(_spans(text, *p) for p in PATTERNS))))
    found = found.withColumn("tokens", _spans(text, "random", _TOKEN, 0, 20))
    base = F.col("base")
    apart = F.filter("tokens", lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    plain = F.filter(apart, lambda t: t["body"].rlike("[A-Za-z]"))

    def tested(t: Column) -> Column:
        natural = ~t["body"].rlike("[0-9]")
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), _class_of(F.length(t["body"])).alias("class"), _bin_of(t["body"]).alias("bin"), natural.alias("natural"))

    return found.withColumn("tokens", F.transform(plain, tested)).withColumn("names", F.flatten(F.transform(_stretches(text), _names)))


def all_names(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """class, text: a row for each of the names that ``scan`` gives."""
    stretches = docs.select(F.explode(_stretches(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("stretch"))
    return stretches.select(F.explode(_names(F.col("stretch"))).alias("x")).select("x.class", "x.text")


def random_bins(tokens: DataFrame, names: DataFrame, rate: float = 0.05) -> DataFrame:
    """class, bin: tokens (column tokens) with digits of this length class are random up to this bin, by the Benjamini-Hochberg rule on empirical p-values; names (class, text) are natural ones."""
    tested = tokens.select(F.explode("tokens").alias("t")).select("t.class", "t.bin", "t.natural")
    counts = tested.unionByName(_name_bins(names).withColumn("natural", F.lit(True))).groupBy("class", "bin").agg(F.count_if("natural").alias("natural"), F.count_if(~F.col("natural")).alias("n"))
    upto = Window.partitionBy("class").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("class")
    sums = counts.select("class", "bin", F.sum("natural").over(upto).alias("natural"), F.sum("n").over(upto).alias("n"), F.sum("natural").over(whole).alias("all_natural"), F.sum("n").over(whole).alias("all"))
    p = (1 + F.col("natural")) / (1 + F.col("all_natural"))
    return sums.filter((F.col("n") > 0) & (p * F.col("all") <= rate * F.col("n"))).groupBy("class").agg(F.max("bin").alias("bin"))


def _limits(tokens: DataFrame, names: DataFrame, rate: float) -> Column:
    """The bins of ``random_bins`` as a map literal: one entry per length class at most."""
    rows = random_bins(tokens, names, rate).collect()
    return F.create_map(*(F.lit(x) for r in rows for x in (r["class"], r["bin"]))) if rows else F.lit(None).cast("map<int,int>")


def _all_spans(limits: Column) -> Column:
    """Base spans and the random tokens, by start and then kind."""
    order = F.create_map(*(F.lit(x) for k, name in enumerate(KINDS) for x in (name, k)))
    picked = F.filter("tokens", lambda t: ~t["natural"] & F.coalesce(t["bin"] <= limits[t["class"]], F.lit(False)))
    both = F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("order"), s["kind"].alias("kind"), s["end"].alias("end"))), F.transform(picked, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("order"), F.lit("random").alias("kind"), t["end"].alias("end"))))
    return F.sort_array(both)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Spans are kind:start:end in code points, end exclusive, of whole matches, by start and then kind. Tokens that overlap a base span are not tested. Null and empty texts have no spans. Repeated rows are scanned each; an empty table gives no rows. Other columns are not read.
    """
    own = docs.select(F.col(id_col), F.col(text_col))
    found = materialize(scan(own, text_col).drop(text_col, "names"), "secret-spans")
    spans = found.withColumn("all", _all_spans(_limits(found, all_names(own, text_col), rate)))
    n = lambda kind: F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("all", lambda s: s["kind"] != "random")
    return spans.select(id_col, n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), n("random").alias("n_random"))


def redact_secrets(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]", rate: float = 0.05) -> DataFrame:
    """``docs`` with each secret of ``text_col`` replaced by ``mark``; overlapping spans become one mark. Null texts stay null; other rows and columns are unchanged, whatever their names."""
    only = docs.select(F.col(text_col).alias("t"))
    limits = _limits(materialize(scan(only, "t").select("tokens"), "secret-tokens"), all_names(only, "t"), rate)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("t"))
    found = scan(whole, "t").withColumn("all", _all_spans(limits))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(F.col("t"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, piece).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("all", start, cut, lambda acc: F.concat(acc["out"], F.substring(F.col("t"), acc["at"] + 1, F.length(F.col("t")))))
    text = F.when(F.col("t").isNull() | (F.size("all") == 0), F.col("t")).otherwise(clean)
    return found.select(*((text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
