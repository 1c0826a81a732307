"""Secret scan: fixed patterns, and a randomness test battery. DataFrame functions only.

Fixed patterns find assignments, access keys and long hexadecimal runs. The battery looks
at the other runs of 20 or more base-64 characters, what base spans leave of a run
included; an equals sign is part of a run only as its trailing padding. The alphabet is
inferred (lower or upper hexadecimal, base 32, else base 64), and against a uniform source
over it

* chi-squared compares the counts of the symbols,
* a runs test counts changes between the lower and the upper half of the alphabet,
* serial correlation compares neighbouring symbols.

The squares of the three make one statistic. Under randomness it is chi-squared with three
degrees of freedom, and a run that this rejects is not random. Under a model of ordinary
text it is noncentral: by how much, follows from the length and from how uneven the
letters of ordinary text are in that alphabet. Its lower tail there is the run's p-value,
so that short runs, which no test tells apart, have large ones. Over all candidates of the
corpus, Benjamini-Hochberg at ``FALSE_DISCOVERIES`` within each alphabet and length class
sets the limit.

P-values are counted in logarithmic bins: the corpus is seen twice, nothing is shuffled
but those counts, and no text leaves its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the base scan: name, pattern, group whose length counts, least length.
BASE_KINDS = [
    ("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", "AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
]
#: What a text must hold for the pattern to be worth applying; none loses a match that counts.
BASE_HINTS = {"assign": "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]", "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}"}
RANDOM = "random"
LEAST_RUN = 20
CANDIDATE = "([A-Za-z0-9+/_-]{20,})(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
# Alphabets in order of inference: name, pattern, symbols, excess of ordinary text (size * sum of squared frequencies - 1,
# about that of English and of identifiers written in the alphabet).
ALPHABETS = [
    ("hex_lower", "^[0-9a-f]+$", "0123456789abcdef", 0.6),
    ("hex_upper", "^[0-9A-F]+$", "0123456789ABCDEF", 0.6),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 3.2),
]
#: The battery rejects a run whose p-value under randomness is below this.
LEAST_RANDOM = 0.001
FALSE_DISCOVERIES = 0.05
_BINS_PER_E = 32
_LOWEST_BIN = -1600


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str, group: int, least: int, hint: str) -> Column:
    """Array of ``struct<start, end>``: leftmost non-overlapping matches whose group has ``least`` characters; code points, end exclusive."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found, F.length)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    steps = F.arrays_zip(F.transform(F.slice(pieces, 1, F.size(found)), F.length).alias("gap"), F.transform(found, F.length).alias("own"), sizes.alias("counted"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["own"]
        kept = F.when(x["counted"] >= least, F.array_append(state["out"], F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end")))).otherwise(state["out"])
        return F.struct(end.cast("bigint").alias("at"), kept.alias("out"))

    spans = F.aggregate(steps, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(hint), spans).otherwise(none)


def normal_below(z: Column) -> Column:
    """Standard normal distribution function, to 2e-4 (a logistic approximation, monotone)."""
    return 1 / (1 + F.exp(-(z * 1.5976 + F.pow(z, F.lit(3)) * 0.07056)))


def chi_squared_z(x: Column, apart: Column) -> Column:
    """Normal score of a noncentral chi-squared with three degrees of freedom and the noncentrality ``apart`` (Sankaran's power approximation)."""
    mean, spread = apart + 3, (apart * 2 + 3) / F.pow(apart + 3, F.lit(2))
    h = 1 - (apart + 3) * (apart * 3 + 3) * 2 / (F.pow(apart * 2 + 3, F.lit(2)) * 3)
    m = (h - 1) * (1 - h * 3)
    centre = 1 + h * spread * (h - 1 - (2 - h) * m * spread / 2)
    return (F.pow(x / mean, h) - centre) / (h * F.sqrt(spread * 2) * (1 + m * spread / 2))


def battery(token: Column) -> Column:
    """``struct<alphabet, n, z_chi, z_runs, z_serial, p_random, p_ordinary>`` of a run without padding; both p-values are of the three tests together."""
    alphabet = F.lit(len(ALPHABETS) - 1)
    for k, (_, pattern, _, _) in reversed([*enumerate(ALPHABETS)][:-1]):
        alphabet = F.when(token.rlike(pattern), k).otherwise(alphabet)

    def by_alphabet(k: Column) -> Column:
        symbols = F.element_at(F.array(*(F.lit(a[2]) for a in ALPHABETS)), k + 1)
        size = F.length(symbols).cast("double")
        excess = F.element_at(F.array(*(F.lit(a[3]) for a in ALPHABETS)), k + 1)
        n = F.length(token).cast("double")
        values = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: (F.instr(symbols, c) - 1).cast("double"))
        squares = F.aggregate(F.transform(F.filter(F.split(symbols, ""), lambda c: c != ""), lambda c: F.pow(n - F.length(F.replace(token, c)), F.lit(2))), F.lit(0.0), lambda s, x: s + x)
        chi = squares * size / n - n
        z_chi = (chi - (size - 1)) / F.sqrt((size - 1) * 2 * (n - 1) / n)
        apart = F.pow(n * excess, F.lit(2)) / ((size - 1) * 2)

        def of_values(v: Column) -> Column:
            total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
            pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
            high = total(F.transform(v, lambda x: F.when(x * 2 >= size, 1.0).otherwise(0.0)))
            changes = total(F.transform(pairs, lambda p: F.when((p["x"] * 2 >= size) != (p["y"] * 2 >= size), 1.0).otherwise(0.0)))

            def of_mean(m: Column) -> Column:
                spread = total(F.transform(v, lambda x: (x - m["mean"]) * (x - m["mean"])))
                together = total(F.transform(pairs, lambda p: (p["x"] - m["mean"]) * (p["y"] - m["mean"])))
                product = m["high"] * (n - m["high"]) * 2
                runs_mean, runs_var = product / n + 1, product * (product - n) / (n * n * (n - 1))
                z_runs = F.when(runs_var > 0, (m["changes"] + 1 - runs_mean) / F.sqrt(runs_var)).otherwise(99.0)
                z_serial = F.when(spread > 0, (together / spread + 1 / n) * F.sqrt(n)).otherwise(99.0)
                return F.struct(z_runs.alias("z_runs"), z_serial.alias("z_serial"))

            return let(F.struct((total(v) / n).alias("mean"), high.alias("high"), changes.alias("changes")), of_mean)

        def combined(z: Column) -> Column:
            s = F.pow(F.greatest(z_chi, F.lit(0.0)), F.lit(2)) + z["z_runs"] * z["z_runs"] + z["z_serial"] * z["z_serial"]
            p_random = 1 - normal_below(chi_squared_z(s, F.lit(0.0)))
            p_ordinary = normal_below(chi_squared_z(s, apart))
            return F.struct(k.alias("alphabet"), n.alias("n"), z_chi.alias("z_chi"), z["z_runs"].alias("z_runs"), z["z_serial"].alias("z_serial"), p_random.alias("p_random"), p_ordinary.alias("p_ordinary"))

        return let(let(values, of_values), combined)

    return let(alphabet, by_alphabet)


def without(text: Column, spans: Column) -> Column:
    """``text`` with each of ``spans``, in order of their starts, blanked out; no other place moves."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    upto = lambda begin, end: F.substring(text, (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))

    def step(state: Column, s: Column) -> Column:
        end = F.greatest(state["at"], s["end"])
        begin = F.greatest(state["at"], s["start"])
        return F.struct(end.cast("bigint").alias("at"), F.concat(state["out"], upto(state["at"], begin), F.repeat(F.lit(" "), (end - begin).cast("int"))).alias("out"))

    blanked = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], upto(s["at"], F.length(text).cast("bigint"))))
    return F.when(F.size(spans) > 0, blanked).otherwise(text)


def candidates(text: Column) -> Column:
    """Array of ``struct<start, end, t>`` of the runs that the battery tests, padding included; t as of :func:`battery`."""
    spans = matches(text, CANDIDATE, 1, LEAST_RUN, CANDIDATE)

    def tested(s: Column) -> Column:
        run = F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        return let(F.rtrim(run, F.lit("=")), lambda tok: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(tok).alias("t")))

    return F.transform(spans, tested)


def length_class(t: Column) -> Column:
    """Number of the alphabet and length class: half octaves of the length."""
    return (t["alphabet"] * 1000 + F.floor(F.log2(t["n"]) * 2)).cast("int")


def p_bin(t: Column) -> Column:
    """Logarithmic bin of the p-value, by its upper edge exp(bin / 32)."""
    return F.greatest(F.ceil(F.ln(F.greatest(t["p_ordinary"], F.lit(1e-300))) * _BINS_PER_E), F.lit(_LOWEST_BIN)).cast("int")


def discovery_limits(found: DataFrame, q: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """Largest bin that Benjamini-Hochberg rejects, by class, from ``found(t)`` of all candidates."""
    counts = found.select(length_class(F.col("t")).alias("class"), p_bin(F.col("t")).alias("bin")).groupBy("class", "bin").agg(F.count("*").alias("n"))
    own = Window.partitionBy("class")
    rejected = counts.withColumn("k", F.sum("n").over(own.orderBy("bin"))).withColumn("m", F.sum("n").over(own)).filter(F.exp(F.col("bin") / _BINS_PER_E) <= F.col("k") / F.col("m") * q)
    # alphabets times half octaves: a few dozen rows, whatever the corpus
    return {r["class"]: r["limit"] for r in rejected.groupBy("class").agg(F.max("bin").alias("limit")).collect()}


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = FALSE_DISCOVERIES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, base, random``.

    ``base`` holds ``struct<start, kind, end>`` of the fixed patterns (kind is the number in
    ``BASE_KINDS``), in order; ``random`` those runs that the battery adds, which no base
    span touches. Null and empty texts have none. Ids may be null or repeated; every row is
    answered. Other columns are ignored.
    """
    span = lambda kind: lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))
    text = F.col("text")
    base = F.array_sort(F.concat(*(F.transform(matches(text, pattern, group, least, BASE_HINTS[name]), span(k)) for k, (name, pattern, group, least) in enumerate(BASE_KINDS))))
    doc = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    tested = lambda base: let(without(text, base), candidates)
    hinted = text.rlike(CANDIDATE)
    limits = discovery_limits(doc.filter(hinted).select("text", base.alias("base")).select(F.explode(tested(F.col("base"))).alias("c")).select("c.t"), q)
    out = doc.select("doc_id", "text", base.alias("base"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    if not limits:
        return out.select("doc_id", "base", none.alias("random"))
    limit = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))
    secret = lambda c: (c["t"]["p_random"] >= LEAST_RANDOM) & (p_bin(c["t"]) <= F.coalesce(F.element_at(limit, length_class(c["t"])), F.lit(_LOWEST_BIN - 1)))
    added = F.when(hinted, F.transform(F.filter(tested(F.col("base")), secret), span(len(BASE_KINDS)))).otherwise(none)
    return out.select("doc_id", "base", added.alias("random"))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in [*(k[0] for k in BASE_KINDS), RANDOM]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
