"""Scalar expressions: content ids, type tests, casts, address and token forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def oid_of(data: Column | str) -> Column:
    """Content id: SHA-1 of the bytes, in hexadecimal."""
    return F.sha1(data)


def cid_of(oid: str) -> Column:
    """Collection id, an aggregate: SHA-1 of the sorted distinct member ids, joined."""
    return F.sha1(F.array_join(F.array_sort(F.collect_set(oid)), ""))


#: Type -> prefixes of the content, in hexadecimal (fixed values: the formats' magic numbers).
MAGIC = {
    "PE": ["4D5A"],
    "ELF": ["7F454C46"],
    "MACHO": ["FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE"],
    "UNIVERSAL": ["CAFEBABE"],
    "ZIP": ["504B0304", "504B0506"],
    "GZIP": ["1F8B"],
    "BZIP2": ["425A68"],
    "XZ": ["FD377A585A00"],
    "7Z": ["377ABCAF271C"],
    "RAR": ["526172211A07"],
    "PDF": ["25504446"],
    "PNG": ["89504E470D0A1A0A"],
    "JPEG": ["FFD8FF"],
    "GIF": ["474946383761", "474946383961"],
    "BMP": ["424D"],
    "TIFF": ["49492A00", "4D4D002A"],
    "MP3": ["494433"],
    "OGG": ["4F676753"],
    "FLAC": ["664C6143"],
    "RIFF": ["52494646"],
    "OLE": ["D0CF11E0A1B11AE1"],
    "RTF": ["7B5C727466"],
    "XML": ["3C3F786D6C"],
    "HTML": ["3C21444F4354595045", "3C68746D6C"],
    "SCRIPT": ["2321"],
    "SQLITE": ["53514C69746520666F726D61742033"],
    "CAB": ["4D534346"],
    "AR": ["213C617263683E"],
    "DEX": ["6465780A"],
    "WASM": ["0061736D"],
    "PCAP": ["D4C3B2A1", "A1B2C3D4"],
    "LUA": ["1B4C7561"],
}


def types_of(data: Column | str) -> Column:
    """Sorted set of the types whose magic number the content starts with; Unknown when there is none."""
    data = F.col(data) if isinstance(data, str) else data
    hits = [F.when(reduce(lambda a, b: a | b, [F.startswith(data, F.unhex(F.lit(p))) for p in prefixes]), F.lit(t)) for t, prefixes in MAGIC.items()]
    found = F.array_sort(F.array_compact(F.array(*hits)))
    return F.when(F.size(found) == 0, F.array(F.lit("Unknown"))).otherwise(found)


#: Category -> types, and category -> extensions; a later rule overrides an earlier one.
TYPE_RULES = [("archive", ["ZIP", "GZIP", "BZIP2", "XZ", "7Z", "RAR", "CAB", "AR"]), ("media", ["PNG", "JPEG", "GIF", "BMP", "TIFF", "MP3", "OGG", "FLAC", "RIFF"]), ("document", ["PDF", "OLE", "RTF", "XML", "HTML"]), ("executable", ["PE", "ELF", "MACHO", "UNIVERSAL", "DEX", "WASM"])]
EXTENSION_RULES = [("certificate", ["pem", "crt", "cer", "der"]), ("source", ["c", "h", "py", "java", "go", "rs", "js", "ts"]), ("jar", ["jar", "war"])]


def category_of(types: Column, extension: Column) -> Column:
    """By type and extension, later rules first; other when none holds."""
    out = F.lit("other")
    for name, some in TYPE_RULES:
        out = F.when(F.arrays_overlap(types, F.array(*map(F.lit, some))), F.lit(name)).otherwise(out)
    for name, some in EXTENSION_RULES:
        out = F.when(F.lower(extension).isin(some), F.lit(name)).otherwise(out)
    return out


def extension_of(name: Column | str) -> Column:
    """What follows the last dot, null without a dot."""
    name = F.col(name) if isinstance(name, str) else name
    return F.when(F.contains(name, F.lit(".")), F.element_at(F.split(name, r"\."), -1))


def mnemonic_of(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+", 2)[0]


def operands_of(text: Column) -> Column:
    """All after the first white space, null when there is nothing."""
    return F.get(F.split(F.trim(text), r"\s+", 2), F.lit(1))


#: Words that are levels of a log (fixed values).
LEVELS = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]


def cast_text(text: Column) -> Column:
    """A struct of the first reading that fits: boolean, integer (also 0x), float, log level, else text."""
    low = F.lower(F.trim(text))
    as_bool = F.when(low == "true", True).when(low == "false", False)
    as_int = F.when(low.rlike("^[+-]?[0-9]{1,18}$"), low.try_cast("long")).when(low.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(low, 3, 16), 16, 10).try_cast("long"))
    as_float = F.when(low.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), low.try_cast("double"))
    level = F.when(F.upper(F.trim(text)).isin(LEVELS), F.upper(F.trim(text)))
    kind = F.when(as_bool.isNotNull(), "bool").when(as_int.isNotNull(), "int").when(as_float.isNotNull(), "float").when(level.isNotNull(), "level").otherwise("text")
    return F.struct(kind.alias("kind"), as_bool.alias("as_bool"), as_int.alias("as_int"), as_float.alias("as_float"), level.alias("as_level"))


def decimal_address(text: Column) -> Column:
    """Hexadecimal (0x), octal (0o) or decimal text as decimal text; null for anything else."""
    low = F.lower(F.trim(text))
    return F.when(low.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(low, 3, 40), 16, 10)).when(low.rlike("^0o[0-7]+$"), F.conv(F.substring(low, 3, 40), 8, 10)).when(low.rlike("^[0-9]+$"), F.regexp_replace(low, "^0+(?=[0-9])", ""))


#: Pattern -> placeholder for the generated names in decompiled text (fixed values).
PLACEHOLDERS = [(r"\bLAB_[0-9a-fA-F]+\b", "LAB"), (r"\bDAT_[0-9a-fA-F]+\b", "DAT"), (r"\b[a-z]{1,3}Var[0-9]+\b", "VAR"), (r"\blocal_[0-9a-fA-F]+\b", "LOCAL"), (r"\bparam_[0-9]+\b", "PARAM"), (r"\bFUN_[0-9a-fA-F]+\b", "FUN")]


def canonical_code(text: Column) -> Column:
    """Generated names as placeholders, runs of blanks as one, trimmed."""
    for pattern, to in PLACEHOLDERS:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def complexity_label(n: Column) -> Column:
    return F.when(n < 11, "simple").when(n < 21, "moderate").when(n < 51, "complex").otherwise("needs refactor")


def outcome_label(label: Column, reason: Column) -> Column:
    """A result's label: a failure reason makes it skipped or failed, error and unknown labels are failed."""
    known = F.when(label.isin("safe", "flagged", "failed", "skipped"), label).otherwise("failed")
    return F.when(reason.startswith("skip"), "skipped").when(reason.isNotNull() & (reason != ""), "failed").otherwise(known)


def symbolic_cost(branches: Column, memory: Column, loops: Column, unmodeled: Column) -> Column:
    """Estimated seconds: 2^branches x 0.005 x (1 + memory / 10), half more with loops, twice with unmodeled calls."""
    return F.pow(F.lit(2.0), branches) * 0.005 * (1 + 0.1 * memory) * F.when(loops, 1.5).otherwise(1.0) * F.when(unmodeled, 2.0).otherwise(1.0)


def normalized(text: Column) -> Column:
    """Underscores and non-words as single blanks, lower case, trimmed."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9]+", " "), r"\s+", " ")))
