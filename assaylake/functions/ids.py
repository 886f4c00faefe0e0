"""Identifiers as column expressions: sample, donor and study names, links, slugs and membership hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File-name endings of array files, the first that fits is removed once.
SUFFIXES = ("_(PrimeView).CEL.gz", "_(PrimeView).CEL", "_(PrimeView)", ".CEL.gz", ".CEL", ".cel.gz", ".cel")
# Times of measurement by column, in order.
TIMES = {"egfr_7d": "7d", "egfr_3m": "3m", "egfr_6m": "6m", "egfr_12m": "12m"}
# Names of training losses.
LOSSES = {
    "mse": "mse", "l2": "mse", "huber": "huber", "smooth_l1": "huber", "cosine": "mse_cosine", "mse_cosine": "mse_cosine", "vae": "beta_vae",
    "beta_vae": "beta_vae", "dvib": "beta_vae", "mmd": "mmd", "wae": "mmd", "masked": "masked_mse", "masked_mse": "masked_mse",
}
# Multipliers and modulus of the donors' deterministic order.
DONOR_TIMES, SEED_TIMES, DONOR_MODULUS = 2_654_435_761, 1_013_904_223, 2_147_483_647


def basename(x: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.trim(x), "/+$", ""), "/"), -1)


def sample_id(x: Column) -> Column:
    """Base name without one known suffix, upper and lower case told apart."""
    name = basename(x.cast("string"))
    out = name
    for suffix in reversed(SUFFIXES):
        out = F.when(F.endswith(name, F.lit(suffix)), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(out)
    return F.trim(out)


def plain_sample_id(x: object) -> str:
    """sample_id of one label, for the few labels that are looked at on the driver."""
    name = str(x).strip().rstrip("/").rsplit("/", 1)[-1]
    return next((name.removesuffix(s) for s in SUFFIXES if name.endswith(s)), name).strip()


def legacy_id(x: Column) -> Column:
    """The same in any case, also without a leading GSM number and trailing marks; in capitals."""
    name = F.regexp_replace(basename(x), r"(?i)\.CEL(\.gz)?$", "")
    name = F.regexp_replace(name, r"(?i)^GSM[0-9]+[_-]*", "")
    name = F.regexp_replace(name, r"(?i)[_\s-]*\(?PrimeView\)?[_\s-]*$", "")
    return F.upper(F.trim(F.regexp_replace(name, "_+$", "")))


def donor_of_biopsy(x: Column) -> Column:
    """What stands before a final _L or _P; else all of it."""
    name = F.upper(sample_id(x))
    return F.when(name.rlike("^.+_[LP]$"), F.regexp_extract(name, "^(.+)_([LP])$", 1)).otherwise(name)


def donor_of_patient(x: Column) -> Column:
    return F.split_part(x, F.lit("_"), F.lit(1))


def tissue(x: Column) -> Column:
    letter = F.regexp_extract(F.upper(sample_id(x)), "_([LP])$", 1)
    return F.when(letter == "", F.lit("U")).otherwise(letter)


def slug(x: Column, default: str = "model") -> Column:
    s = F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(s == "", F.lit(default)).otherwise(s)


def number_slug(x: float) -> str:
    return f"{x:.12g}".replace("-", "m").replace(".", "p")


def safe_name(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9._-]+", "_")


def gsm_of_path(x: Column) -> Column:
    found = F.upper(F.regexp_extract(x, "(?i)(GSM[0-9]+)", 1))
    return F.when(found != "", found)


def study_of_archive(x: Column) -> Column:
    found = F.upper(F.regexp_extract(basename(x), "(?i)(GSE[0-9]+)", 1))
    return F.when(found != "", found)


def accession_number(x: Column, prefix: str = "GSE") -> Column:
    """The number by which accessions are sorted; what has none comes last."""
    return F.coalesce(F.regexp_replace(F.upper(x), prefix, "").try_cast("bigint"), F.lit(10**18))


def accession_url(x: Column, base: str) -> Column:
    return F.concat(F.lit(base), F.url_encode(F.upper(F.trim(x))))


def archive_url(x: Column, base: str) -> Column:
    """Series archives lie in folders named after all but the last three digits."""
    study = F.upper(F.trim(x))
    digits = F.regexp_replace(study, "^GSE", "")
    folder = F.concat(F.lit("GSE"), F.substring(digits, F.lit(1), F.length(digits) - 3), F.lit("nnn"))
    return F.when(digits.rlike("^[0-9]{3,}$"), F.concat(F.lit(base), folder, F.lit("/"), study, F.lit("/suppl/"), study, F.lit("_RAW.tar")))


def markdown_link(text: Column, url: Column) -> Column:
    return F.concat(F.lit("["), text, F.lit("]("), url, F.lit(")"))


def fit_id(repeat: Column, fold: Column, model: Column) -> Column:
    return F.format_string("fixed_r%03d_f%03d_%s", repeat, fold, slug(model))


def sample_key(namespace: Column, x: Column) -> Column:
    return F.concat(F.upper(F.trim(namespace)), F.lit(":"), F.upper(F.trim(x)))


def id_of_key(key: Column) -> Column:
    return F.substring(key, F.instr(key, ":") + 1, F.length(key))


def membership_hash(key: Column) -> Column:
    """An aggregate: SHA-256 of the sorted keys, a line each. For an id list of one cohort, not for a corpus."""
    return F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list(key)), "\n"), F.lit("\n")), 256)


def ordered_digest(order: Column, key: Column) -> Column:
    """An aggregate: SHA-256 of the keys in order, a line each but the last."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), key.alias("k"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["k"]), "\n"), 256)


def byte_size(x: Column) -> Column:
    """To one digit in the largest unit; a half goes to the even digit, as C and Python write doubles, where Java's formats round it up."""
    out = None
    for power, unit in ((4, "TiB"), (3, "GiB"), (2, "MiB"), (1, "KiB")):
        size = x.cast("double") / float(1024**power)
        whole = F.floor(size)
        tenths = whole * 10 + F.rint((size - whole) * 10).cast("bigint")  # exact: what is behind the point has few bits
        text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = text if out is None else F.when(x < 1024 ** (power + 1), text).otherwise(out)
    return F.when(x < 1024, F.concat(x.cast("bigint").cast("string"), F.lit(" B"))).otherwise(out)


def loss_name(x: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(v) for kv in LOSSES.items() for v in kv)), F.lower(F.trim(x)))


def hidden_widths(x: Column) -> Column:
    """Widths between arrows, semicolons or commas: one to eight whole numbers from 2 to 8192, else an error."""
    parts = F.filter(F.split(x, r"→|->|;|,"), lambda w: F.trim(w) != "")
    widths = F.transform(parts, lambda w: F.trim(w).try_cast("int"))
    good = F.size(widths).between(1, 8) & F.forall(widths, lambda w: F.coalesce(w.between(2, 8192), F.lit(False)))
    return F.when(F.coalesce(good, F.lit(False)), widths).otherwise(F.raise_error(F.concat(F.lit("hidden widths must be 1 to 8 numbers from 2 to 8192, not "), F.coalesce(x, F.lit("null")))).cast("array<int>"))


def donor_score(number: Column, seed: int) -> Column:
    """A pseudo-random order of numbered donors; numbers below 3e9 stay within 64 bits."""
    return F.pmod(number.cast("bigint") * F.lit(DONOR_TIMES) + F.lit(seed % 100_000 * SEED_TIMES), F.lit(DONOR_MODULUS))


def text_donor_score(donor: Column, seed: int, salt: str) -> Column:
    """The same for other names: the first 64 bits of a SHA-256, as a decimal."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}|{seed}|"), F.upper(donor)), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def truthy(x: Column) -> Column:
    return F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes")
