"""Operator 3: license detection by ordered signature rules, with DataFrame functions only.

Texts are reduced to lower-case words joined by single spaces. A rule is a regex over those words
with a label, a priority, a confidence, a keyword of its form and keywords of its license; it runs only
on texts that hold the first and one of the others, and only texts with the first keyword of some rule
are looked at (``gate()``). The rules are written by hand as a table of licenses (name, names in prose,
identifier) and the forms in which each is mentioned, and as signatures of license bodies, headers and
notices (``signatures.py``); ``rules()`` spells out all of them.

Every match is an interval of words. A match is suppressed if another one of the same or a higher
priority contains it; of two equal intervals the one of higher priority, then of the earlier rule,
stays. That is decided by running maxima over the matches of a text in order of their begin, so a
text with many matches costs no pairwise comparison; a match's row carries nothing of its text. Base
phrases are counted apart from the rules and their labels always stay.

Nulls: a null text has no words and no labels; a null doc_id is kept. Rows that repeat a doc_id are
scanned each. An empty table gives an empty one. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.signatures import signatures

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose places are counted, and their labels (fixed values).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label; how prose names it, as a regex over words; its identifier in words; keywords, one of which every such mention holds.
LICENSES = (
    ("mit", "(?:mit|expat|x11)", "mit", "mit|expat|x11"),
    ("mit-0", "mit no attribution", "mit 0", "mit"),
    ("isc", "(?:isc|internet systems consortium)", "isc", "isc|internet systems consortium"),
    ("zlib", "zlib(?: libpng)?", "zlib", "zlib"),
    ("libpng-2.0", "(?:libpng|png reference library)(?: version| ?v)? ?2", "libpng 2 0", "png"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public)", "wtfpl", "wtfpl|do what the"),
    ("0bsd", "(?:0bsd|zero clause bsd|bsd zero clause)", "0bsd", "bsd"),
    ("bsd-1-clause", "(?:bsd 1 clause|1 clause bsd)", "bsd 1 clause", "bsd"),
    ("bsd-2-clause", "(?:(?:simplified|freebsd) bsd|bsd 2 clause|2 clause bsd|freebsd)", "bsd 2 clause", "bsd"),
    ("bsd-3-clause", "(?:(?:new|modified|revised) bsd|bsd 3 clause|3 clause bsd)", "bsd 3 clause", "bsd"),
    ("bsd-4-clause", "(?:(?:original|old) bsd|bsd 4 clause|4 clause bsd)", "bsd 4 clause", "bsd"),
    ("bsd", "bsd(?: style)?", "bsd", "bsd"),
    ("apache-1.0", "apache(?: software)?(?: license)?(?: version| ?v)? ?1 0", "apache 1 0", "apache"),
    ("apache-1.1", "apache(?: software)?(?: license)?(?: version| ?v)? ?1 1", "apache 1 1", "apache"),
    ("apache-2.0", "apache(?: software)?(?: licen[cs]e)?(?: version| ?v)? ?2(?: 0)?", "apache 2 0", "apache"),
    ("apache", "apache(?: software)?", "apache", "apache"),
    ("gpl-1.0", "(?:gnu )?(?:general public licen[cs]e|gpl)(?: gpl)?(?: version| ?v)? ?1(?: 0)?", "gpl 1 0", "gpl|general public"),
    ("gpl-2.0", "(?:gnu )?(?:general public licen[cs]e|gpl)(?: gpl)?(?: version| ?v)? ?2(?: 0)?", "gpl 2 0", "gpl|general public"),
    ("gpl-3.0", "(?:gnu )?(?:general public licen[cs]e|gpl)(?: gpl)?(?: version| ?v)? ?3(?: 0)?", "gpl 3 0", "gpl|general public"),
    ("gpl", "(?:gnu general public|gnu gpl|gpl)", "gpl", "gpl|general public"),
    ("lgpl-2.0", "(?:gnu )?(?:library general public licen[cs]e|lgpl)(?: version| ?v)? ?2(?: 0)?", "lgpl 2 0", "lgpl|library general"),
    ("lgpl-2.1", "(?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version| ?v)? ?2 1", "lgpl 2 1", "lgpl|lesser general"),
    ("lgpl-3.0", "(?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version| ?v)? ?3(?: 0)?", "lgpl 3 0", "lgpl|lesser general"),
    ("lgpl", "(?:gnu )?(?:lesser general public|library general public|lgpl)", "lgpl", "lgpl|lesser general|library general"),
    ("agpl-3.0", "(?:gnu )?(?:affero general public licen[cs]e|agpl)(?: version| ?v)? ?3(?: 0)?", "agpl 3 0", "agpl|affero"),
    ("agpl", "(?:gnu )?(?:affero general public|agpl)", "agpl", "agpl|affero"),
    ("gfdl", "(?:gnu )?(?:free documentation|gfdl|fdl)(?: version| ?v)?(?: ?1 [123])?", "gfdl", "fdl|free documentation"),
    ("mpl-1.0", "mozilla public(?: licen[cs]e)?(?: version| ?v)? ?1 0", "mpl 1 0", "mpl|mozilla"),
    ("mpl-1.1", "mozilla public(?: licen[cs]e)?(?: version| ?v)? ?1 1", "mpl 1 1", "mpl|mozilla"),
    ("mpl-2.0", "(?:mozilla public(?: licen[cs]e)?(?: mpl)?|mpl)(?: version| ?v)? ?2(?: 0)?", "mpl 2 0", "mpl|mozilla"),
    ("mpl", "mozilla public", "mpl", "mpl|mozilla"),
    ("epl-1.0", "(?:eclipse public(?: licen[cs]e)?|epl)(?: version| ?v)? ?1(?: 0)?", "epl 1 0", "epl|eclipse public"),
    ("epl-2.0", "(?:eclipse public(?: licen[cs]e)?|epl)(?: version| ?v)? ?2(?: 0)?", "epl 2 0", "epl|eclipse public"),
    ("edl-1.0", "eclipse distribution(?: licen[cs]e)?(?: version| ?v)?(?: ?1 0)?", "edl 1 0", "edl|eclipse distribution"),
    ("cddl-1.0", "(?:common development and distribution|cddl)(?: licen[cs]e)?(?: version| ?v)?(?: ?1(?: 0)?)?", "cddl 1 0", "cddl|common development"),
    ("cpl-1.0", "common public(?: licen[cs]e)?(?: version| ?v)?(?: ?1 0)?", "cpl 1 0", "cpl|common public"),
    ("eupl-1.1", "(?:european union public licen[cs]e|eupl)(?: version| ?v)? ?1 1", "eupl 1 1", "eupl|european union"),
    ("eupl-1.2", "(?:european union public licen[cs]e|eupl)(?: version| ?v)? ?1 2", "eupl 1 2", "eupl|european union"),
    ("cecill-2.1", "cecill(?: version| ?v)?(?: ?2 1)?", "cecill 2 1", "cecill"),
    ("artistic-1.0", "artistic(?: licen[cs]e)?(?: version| ?v)? ?1(?: 0)?", "artistic 1 0", "artistic"),
    ("artistic-2.0", "artistic(?: licen[cs]e)?(?: version| ?v)? ?2(?: 0)?", "artistic 2 0", "artistic"),
    ("boost-1.0", "boost software(?: licen[cs]e)?(?: version| ?v)?(?: ?1 0)?", "bsl 1 0", "bsl|boost software"),
    ("bsl-1.1", "business source(?: licen[cs]e)?(?: version| ?v)?(?: ?1 1)?", "busl 1 1", "busl|business source"),
    ("sspl-1.0", "(?:server side public|sspl)", "sspl 1 0", "sspl|server side public"),
    ("elastic-2.0", "elastic(?: licen[cs]e)?(?: version| ?v)? ?2(?: 0)?", "elastic 2 0", "elastic"),
    ("python-2.0", "(?:python software foundation|psf)(?: licen[cs]e)?(?: version| ?v)?(?: ?2)?", "python 2 0", "python|psf"),
    ("php-3.01", "php(?: licen[cs]e)?(?: version| ?v)? ?3 01", "php 3 01", "php"),
    ("ruby", "ruby", "ruby", "ruby"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("ofl-1.1", "(?:sil )?open font(?: licen[cs]e)?(?: version| ?v)?(?: ?1 1)?", "ofl 1 1", "ofl|open font"),
    ("odbl-1.0", "(?:open database|odbl)(?: licen[cs]e)?(?: version| ?v)?(?: ?1 0)?", "odbl 1 0", "odbl|open database"),
    ("pddl-1.0", "public domain dedication and", "pddl 1 0", "pddl|public domain dedication"),
    ("cc0-1.0", "(?:cc0|creative commons zero)(?: 1 0)?", "cc0 1 0", "cc0|creative commons zero"),
    ("cc-by-3.0", "(?:cc by|creative commons attribution)(?: 3 0)", "cc by 3 0", "cc by|creative commons attribution"),
    ("cc-by-4.0", "(?:cc by|creative commons attribution)(?: international)?(?: 4 0)", "cc by 4 0", "cc by|creative commons attribution"),
    ("cc-by-sa-3.0", "(?:cc by sa|creative commons attribution share ?alike)(?: 3 0)", "cc by sa 3 0", "cc by|creative commons attribution"),
    ("cc-by-sa-4.0", "(?:cc by sa|creative commons attribution share ?alike)(?: 4 0)", "cc by sa 4 0", "cc by|creative commons attribution"),
    ("cc-by-nc-4.0", "(?:cc by nc|creative commons attribution non ?commercial)(?: 4 0)", "cc by nc 4 0", "cc by|creative commons attribution"),
    ("cc-by-nc-sa-4.0", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: 4 0)", "cc by nc sa 4 0", "cc by|creative commons attribution"),
    ("cc-by-nd-4.0", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: 4 0)", "cc by nd 4 0", "cc by|creative commons attribution"),
    ("cc-by-nc-nd-4.0", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: 4 0)", "cc by nc nd 4 0", "cc by|creative commons attribution"),
    ("cc-by", "(?:cc by|creative commons attribution)", "cc by", "cc by|creative commons attribution"),
    ("ms-pl", "microsoft public", "ms pl", "ms pl|microsoft public"),
    ("ms-rl", "microsoft reciprocal", "ms rl", "ms rl|microsoft reciprocal"),
    ("ncsa", "(?:university of illinois ncsa|ncsa)(?: open source)?", "ncsa", "ncsa"),
    ("w3c", "w3c(?: software)?(?: notice and)?", "w3c", "w3c"),
    ("vim", "vim", "vim", "vim"),
    ("public-domain", "public domain", "public domain", "public domain"),
)

#: Words after "license" by which it is a permit, a plate or a product, and not a license of this list. Words that
#: often begin the next sentence (tests, servers) are not among them, as texts are scanned without their full stops.
PERMITS = r"(?! (?:plates?|fees?|keys?|numbers?|holders?|offices?|renewals?|revenues?)\b)"

#: How a license is mentioned: form, with {name} or {id}; priority; confidence; a keyword of the form's own.
FORMS = (
    (r"\bspdx license identifier {id}(?: only| or later)?\b", 4, 1.0, "spdx"),
    (r"\b(?:licensed|released|distributed|published|available|provided) under (?:the |an? )?(?:terms of (?:the )?)?{name}(?: (?:public )?licen[cs]e)?(?: version \d(?: \d)?)?\b", 3, 0.95, "under"),
    (r"\b(?:the )?{name} (?:public )?licen[cs]e\b" + PERMITS, 2, 0.9, "licen"),
    (r"\b(?:the )?{name}\b(?<=\d)(?<!\bx11)" + PERMITS, 2, 0.85, "licen"),
    (r"\b(?:opensource org|spdx org|creativecommons org|choosealicense com|gnu org|apache org) licenses? {id}\b", 2, 0.9, "license"),
)


#: The keyword "under" as it stands in its form, where "under" alone is in too many texts.
ENDS = {"under": ("ed under", "able under")}


def gate() -> list[str]:
    """Every match of a rule holds one of these."""
    return list(dict.fromkeys(word for rule in rules() for word in ENDS.get(rule[3], (rule[3],))))


def rules() -> list[tuple[str, int, float, str, list[str], str]]:
    """All rules in order: label, priority, confidence, the form's keyword, the license's keywords, regex."""
    mentions = [(label, priority, sure, own, word.split("|"), form.format(name=name, id=ident)) for form, priority, sure, own in FORMS for label, name, ident, word in LICENSES]
    return mentions + signatures()


def _spaces(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("int")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels and labels (sorted arrays), score."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWERED), OTHER, " "))
    rows = docs.select(F.col("doc_id").cast("long"), plain.alias("plain")).withColumn("row", F.monotonically_increasing_id())

    table = F.array(*(F.struct(*((F.array(*map(F.lit, v)) if k == "words" else F.lit(v)).alias(k) for k, v in zip(("label", "priority", "sure", "own", "words", "regex"), rule, strict=True))) for rule in rules()))
    hits = F.transform(
        F.filter(table, lambda r: F.contains(F.col("plain"), r["own"]) & F.exists(r["words"], lambda w: F.contains(F.col("plain"), w)) & F.rlike(F.col("plain"), r["regex"])),
        lambda r: F.struct(
            r["label"].alias("label"),
            r["priority"].alias("priority"),
            r["sure"].alias("sure"),
            F.filter(
                F.zip_with(F.split(F.col("plain"), r["regex"]), F.regexp_extract_all(F.col("plain"), r["regex"], F.lit(0)), lambda p, m: F.struct(_spaces(p).alias("gap"), _spaces(m).alias("long"))),
                lambda x: x["long"].isNotNull(),
            ).alias("places"),
        ),
    )
    def _base_at(w: Column, i: Column) -> Column:
        label = F.lit(None).cast("string")
        for phrase, name in BASE:
            parts = phrase.split(" ")
            here = F.get(w, i) == parts[0]
            for k, part in enumerate(parts[1:], 1):
                here = here & (F.get(w, i + k) == part)
            label = F.when(here, F.lit(name)).otherwise(label)
        return F.struct(i.cast("long").alias("at"), label.alias("label"))

    # a column of its own: inside a lambda the split would be made anew for every word
    words = F.when(F.contains(F.col("plain"), F.lit("license")), F.split(F.col("plain"), " "))
    places = F.filter(F.transform(F.col("words"), lambda x, i: _base_at(F.col("words"), i)), lambda s: s["label"].isNotNull())

    rows = rows.withColumn("words", words).withColumn("base", F.coalesce(places, F.array().cast("array<struct<at:long,label:string>>"))).select(
        "row", "doc_id",
        F.when(F.col("plain") == "", F.lit(0)).otherwise(_spaces(F.col("plain")) + 1).cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.at")).alias("first_word"),
        F.array_max(F.col("base.at")).alias("last_word"),
        F.array_sort(F.array_distinct(F.col("base.label"))).alias("base_labels"),
        F.when(reduce(or_, (F.contains(F.col("plain"), F.lit(word)) for word in gate())), hits).alias("hits"),
    )
    head = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    found = rows.select(*head, F.posexplode_outer("hits").alias("rule", "hit"))
    found = found.select(*head, "rule", "hit.label", "hit.priority", "hit.sure", F.posexplode_outer("hit.places").alias("nth", "place"))
    found = found.select(*head, "rule", "label", "priority", "sure", "nth", "place.gap", "place.long").repartition("row")

    run = Window.partitionBy("row", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("last", F.sum(F.col("gap") + F.col("long")).over(run)).withColumn("begin", F.col("last") - F.col("long"))
    before = Window.partitionBy("row").orderBy("begin", F.desc("last"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({rule[1] for rule in rules()})
    cover = F.lit(None).cast("long")
    for level in levels:
        cover = F.when(F.col("priority") == level, F.max(F.when(F.col("priority") >= level, F.col("last"))).over(before)).otherwise(cover)
    kept = found.withColumn("kept", F.col("label").isNotNull() & (F.coalesce(cover, F.lit(-1).cast("long")) < F.col("last")))
    done = kept.groupBy("row").agg(
        *(F.first(c).alias(c) for c in head[1:]),
        F.collect_set(F.when(F.col("kept"), F.col("label"))).alias("found"),
        F.max(F.when(F.col("kept"), F.col("sure"))).alias("sure"),
    )
    return done.select(
        *head[1:],
        F.array_sort(F.array_union("base_labels", "found")).alias("labels"),
        F.coalesce("sure", F.when(F.col("n_base") > 0, F.lit(0.9)), F.lit(0.0)).alias("score"),
    )
