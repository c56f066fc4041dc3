"""Decoders and parsers for hardware evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the kernel and of processor manuals
TAINT = [  # letter, bit, meaning, speaks for hardware
    ("G", 0, "Proprietary module loaded", False), ("F", 1, "Module force-loaded", False), ("S", 2, "Out-of-spec hardware", False),
    ("R", 3, "Module force-unloaded", False), ("M", 4, "Machine Check Exception occurred", True), ("B", 5, "Bad page referenced", True),
    ("U", 6, "Taint requested by userspace", False), ("D", 7, "Kernel died (prior OOPS/BUG)", False), ("A", 8, "ACPI table overridden", False),
    ("W", 9, "Kernel warning triggered", False), ("C", 10, "Staging driver loaded", False), ("I", 11, "Firmware workaround applied", False),
    ("O", 12, "Out-of-tree module loaded", False), ("E", 13, "Unsigned module loaded", False), ("L", 14, "Soft lockup previously occurred", False),
    ("K", 15, "Kernel live-patched", False), ("X", 16, "Auxiliary distro taint", False), ("T", 17, "Struct layout randomized (RANDSTRUCT)", False),
]
MCA = {
    0x0001: "Unclassified error", 0x0002: "Microcode ROM parity error", 0x0003: "External error", 0x0004: "FRC error", 0x0005: "Internal parity error",
    0x0010: "L0 instruction cache error", 0x0020: "L1 data cache error", 0x0030: "L1 cache error", 0x0080: "Generic memory error", 0x0090: "Memory read error",
    0x00A0: "Memory write error", 0x00C0: "Memory scrubbing error", 0x0100: "L0 TLB error", 0x0110: "L1 TLB error", 0x0120: "L2 TLB error",
    0x0800: "Generic bus error", 0x0900: "I/O transaction error", 0x0A00: "PCIe bus error", 0x8000: "Memory ECC corrected",
    0xC000: "Memory ECC uncorrected (channel 0)", 0xC001: "Memory ECC uncorrected (channel 1)", 0xC002: "Memory ECC uncorrected (channel 2)", 0xC003: "Memory ECC uncorrected (channel 3)",
}
BLOCK_MAJORS = {1: "ramdisk", 2: "fd (floppy)", 3: "ide0 / pata", 7: "loop", 8: "sd (SCSI/SATA/USB disk)", 9: "md (software RAID)", 11: "sr (SCSI CD-ROM)", 22: "ide1", 43: "nbd (network block device)", 180: "ub (USB block)", 202: "xvd (Xen virtual)", 259: "nvme (BLOCK_EXT_MAJOR)"}
BLOCK_MAJORS |= {m: "sd (extended)" for m in range(65, 72)}
CHAR_MAJORS = {1: "mem", 4: "tty / serial", 5: "tty alts", 10: "misc", 13: "input", 29: "fb", 89: "i2c", 180: "usb", 188: "ttyUSB"}


def taint_letters(text: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(F.coalesce(text, F.lit("")), r"Tainted:\s*([A-Z ]+)", 1), ""), lambda c: c.rlike("[A-Z]"))


def taint(value: Column) -> Column:
    """array<struct<letter,meaning,hardware>> of a bit mask or of letters; unknown letters are kept."""
    mask = value.try_cast("long")
    of_mask = F.array_compact(F.array(*[F.when(F.bit_get(mask, F.lit(b)) == 1, _flag(*x)) for x in TAINT for b in [x[1]]]))
    letters = F.array_distinct(F.filter(F.split(F.upper(F.regexp_replace(value, "^.*?Tainted:", "")), ""), lambda c: c.rlike("[A-Z]")))

    def known(c: Column) -> Column:
        out = F.struct(c.alias("letter"), F.lit("unknown").alias("meaning"), F.lit(False).alias("hardware"))
        for x in TAINT:
            out = F.when(c == x[0], _flag(*x)).otherwise(out)
        return out

    return F.when(mask.isNotNull(), of_mask).otherwise(F.transform(letters, known))


def _flag(letter: str, bit: int, meaning: str, hardware: bool) -> Column:
    return F.struct(F.lit(letter).alias("letter"), F.lit(meaning).alias("meaning"), F.lit(hardware).alias("hardware"))


def mci_status(hexadecimal: Column) -> Column:
    """struct<valid,overflow,uncorrected,fatal,action_required,error_code,error_type,severity> of a 64-bit status in
    hex. The upper and the lower half are taken apart, so the top bit is no sign."""
    digits = F.lpad(F.regexp_replace(F.lower(hexadecimal), "^0x", ""), 16, "0")
    high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")
    code = F.conv(F.substring(digits, 13, 4), 16, 10).cast("int")
    bit = lambda b: F.bit_get(high, F.lit(b - 32)) == 1
    table = F.create_map(*[F.lit(x) for kv in MCA.items() for x in kv])
    said = F.coalesce(*[F.try_element_at(table, code.bitwiseAND(m)) for m in (0xFFFF, 0xFF00, 0xF000)], F.concat(F.lit("Unknown MCA error 0x"), F.substring(digits, 13, 4)))
    severity = F.when(bit(57), "fatal").when(bit(61), "uncorrected").otherwise("corrected")
    valid = bit(63)
    return F.struct(
        valid.alias("valid"), (valid & bit(62)).alias("overflow"), (valid & bit(61)).alias("uncorrected"), (valid & bit(57)).alias("fatal"), (valid & bit(55)).alias("action_required"),
        code.alias("error_code"), F.when(valid, said).otherwise("Invalid MCE record").alias("error_type"), F.when(valid, severity).alias("severity"),
    )


def device_major(major: Column, kind: Column) -> Column:
    """struct<driver,dynamic>."""
    block = F.create_map(*[F.lit(x) for kv in BLOCK_MAJORS.items() for x in kv])
    char = F.create_map(*[F.lit(x) for kv in CHAR_MAJORS.items() for x in kv])
    found = F.when(kind == "char", F.try_element_at(char, major)).otherwise(F.try_element_at(block, major))
    return F.struct(F.coalesce(found, F.lit("unknown")).alias("driver"), (found.isNull() & major.between(240, 254)).alias("dynamic"))


def mcelog(text: Column) -> Column:
    """array<struct<cpu,bank,status,misc_addr>> of mcelog blocks, which start at 'Hardware event' or 'MCE n' or a blank line."""
    blocks = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n|(?m)(?=^(?:Hardware event|MCE \d+))"), lambda b: b.rlike(r"(?i)STATUS\s+[0-9a-fx]+"))
    get = lambda b, p: F.nullif(F.regexp_extract(b, p, 1), F.lit(""))
    return F.transform(
        blocks,
        lambda b: F.struct(get(b, r"(?i)CPU\s+(\d+)").try_cast("int").alias("cpu"), get(b, r"(?i)BANK\s+(\d+)").try_cast("int").alias("bank"), get(b, r"(?i)STATUS\s+(?:0x)?([0-9a-f]+)").alias("status"), get(b, r"(?i)ADDR\s+(?:0x)?([0-9a-f]+)").alias("addr")),
    )


def ecc_trend(corrected: Column, uncorrected: Column) -> Column:
    return F.when(uncorrected > 0, "critical").when(corrected > 100, "increasing").otherwise("stable")


def event_log(line: Column) -> Column:
    """struct<id,time,sensor,event,severity> of a '|'-separated system event log line."""
    p = F.transform(F.split(line, r"\|"), lambda x: F.trim(x))
    at = lambda i: F.try_element_at(p, F.lit(i))
    said = F.lower(F.concat_ws(" ", at(4), at(5)))
    severity = F.when(said.rlike("uncorrect|critical|non-recoverable"), "Critical").when(said.rlike("correct|warning|threshold"), "Warning").otherwise("Info")
    return F.struct(at(1).alias("id"), F.concat_ws(" ", at(2), at(3)).alias("time"), at(4).alias("sensor"), at(5).alias("event"), severity.alias("severity"))


def inventory(text: Column) -> Column:
    """array<map<string,string>> of inventory sections: their title and fields; empty slots are left out."""
    sections = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda b: F.trim(b) != "")
    def fields(b: Column) -> Column:
        keys = F.regexp_extract_all(b, F.lit(r"(?m)^\s+([^:\n]+):[^\S\n]*(\S[^\n]*)$"), F.lit(1))
        values = F.regexp_extract_all(b, F.lit(r"(?m)^\s+([^:\n]+):[^\S\n]*(\S[^\n]*)$"), F.lit(2))
        title = F.regexp_extract(b, r"(?m)^(\S[^\n]*)$", 1)
        return F.map_concat(F.map_from_arrays(F.array(F.lit("_title")), F.array(title)), F.map_from_entries(F.filter(F.arrays_zip(F.transform(keys, lambda k: F.trim(k)).alias("k"), values.alias("v")), lambda e, i: F.array_position(F.transform(keys, lambda k: F.trim(k)), e["k"]) == i + 1)))

    return F.filter(F.transform(sections, fields), lambda m: ~F.coalesce(F.try_element_at(m, F.lit("Size")) == "No Module Installed", F.lit(False)) & ~F.coalesce(F.try_element_at(m, F.lit("Status")).contains("Unpopulated"), F.lit(False)))


def clock_skew(a: Column, b: Column) -> Column:
    """Absolute seconds between two clocks; NULL from a day on."""
    gap = F.abs(F.unix_timestamp(a) - F.unix_timestamp(b))
    return F.when(gap < 86400, gap)


def decoded_frame(line: Column) -> Column:
    """struct<function,offset,file,line> of a decoded trace line."""
    get = lambda g: F.nullif(F.regexp_extract(line, r"([A-Za-z_][\w.]*)\+(0x[0-9a-f]+)/0x[0-9a-f]+(?:\s+\(?([\w./-]+\.[chS]):(\d+)\)?)?", g), F.lit(""))
    return F.struct(get(1).alias("function"), get(2).alias("offset"), get(3).alias("file"), get(4).try_cast("int").alias("line"))
