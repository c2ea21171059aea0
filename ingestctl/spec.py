"""What one entity of a load looks like. Everything here is plan text, read on the driver."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Row

# Spellings of special delimiters in configuration tables.
DELIMITER_ALIASES = {"Ç": "Ç", "\x01": "\u0001", "x01": "\u0001"}
# Spellings of a flag that is set.
TRUE_TEXTS = {"y", "yes", "true", "t", "1"}
FALSE_TEXTS = {"", "n", "no", "false", "f", "0"}


def parse_flag(value) -> bool:
    """Y/N, true/false, 1/0, a boolean or NULL."""
    if value is None:
        return False
    text = str(value).strip().lower()
    if text in TRUE_TEXTS:
        return True
    if text in FALSE_TEXTS:
        return False
    raise ValueError(f"not a flag: {value!r}")


def normalise_delimiter(value: str) -> str:
    return DELIMITER_ALIASES.get(value, value)


def parse_bytes(text: str) -> int:
    """A size setting such as ``134217728b``, ``128m``, ``1 GB`` or a plain number."""
    match = re.fullmatch(r"\s*(\d+)\s*([kmgt]?)i?b?\s*", str(text).lower())
    if not match:
        raise ValueError(f"not a size: {text!r}")
    return int(match[1]) * 1024 ** " kmgt".index(match[2] or " ")


def parse_names(header: str | list[str] | None) -> list[str]:
    """``'a, b ,c'`` -> ``['a', 'b', 'c']``; a list is only trimmed."""
    if not header:
        return []
    parts = header.split(",") if isinstance(header, str) else header
    return [part.strip() for part in parts]


def parse_positions(text: str) -> list[tuple[int, int]]:
    """``'1-5,6-11'`` -> ``[(1, 5), (6, 11)]``: 1-based, both ends inclusive."""
    ranges = []
    for part in text.strip().split(","):
        start, _, end = part.partition("-")
        try:
            first, last = int(start), int(end)
        except ValueError as error:
            raise ValueError(f"bad position range {part!r} in {text!r}") from error
        if first < 1 or last < first:
            raise ValueError(f"bad position range {part!r} in {text!r}")
        ranges.append((first, last))
    return ranges


def parse_transformations(text: str | None) -> list[tuple[str, str]]:
    """JSON array of ``{column_name, transformation_logic}`` as (name, SQL text) pairs.

    The SQL text is code: only owners of the configuration may write it.
    """
    if text is None or not text.strip():
        return []
    try:
        entries = json.loads(text)
    except json.JSONDecodeError as error:
        raise ValueError(f"the transformations are not JSON: {error}") from error
    return [(entry["column_name"], entry["transformation_logic"]) for entry in entries]


def parse_partition_columns(value) -> list[str]:
    """Nothing, one name, or a list of names."""
    names = [value] if isinstance(value, str) else value or []
    if not isinstance(names, (list, tuple)) or any(not isinstance(name, str) for name in names):
        raise ValueError(f"neither a column name nor a list of them: {value!r}")
    return [name for name in names if name]


def qualified(*parts: str | None) -> str:
    """Join the given name parts with dots; absent catalogue or schema parts are left out."""
    return ".".join(f"`{part}`" for part in parts if part)


@dataclass(frozen=True)
class IngestSpec:
    """One entity to load. Texts that may be malformed are parsed on use, where a failure is audited."""

    entity_name: str
    source_path: str
    file_pattern: str
    delimiter: str | None
    header_flag_text: object
    header_text: str | None
    skip_text: object
    positions: str | None
    target_table: str
    raw_table: str
    raw_flag_text: object
    transformations: str | None
    table_mode: str
    partition_column: object
    audit_table: str
    ledger_table: str
    rules_table: str

    @property
    def header(self) -> list[str]:
        return parse_names(self.header_text)

    @property
    def header_flag(self) -> bool:
        return parse_flag(self.header_flag_text)

    @property
    def raw_flag(self) -> bool:
        return parse_flag(self.raw_flag_text)

    @property
    def skip_lines(self) -> int:
        return int(self.skip_text or 0)

    @property
    def fixed_width(self) -> bool:
        """An empty delimiter means fixed width; NULL does only where positions are given."""
        if self.delimiter is None and not self.positions:
            raise ValueError(f"{self.entity_name}: neither delimiter nor positions given")
        return not self.delimiter

    @classmethod
    def from_config(cls, config: Row) -> IngestSpec:
        delimiter = config["Delimiter"]
        audit = config["Audit_Catalog"], config["Audit_Schema"]
        return cls(
            entity_name=config["Entity_Name"],
            source_path=config["Src_Path"],
            file_pattern=config["File_Pattern"],
            delimiter=None if delimiter is None else normalise_delimiter(delimiter),
            header_flag_text=config["Header_Flag"],
            header_text=config["Header"],
            skip_text=config["Skiplines"],
            positions=config["Fixed_Length_Position"],
            target_table=qualified(config["Target_Catalog"], config["Target_Schema"], config["Entity_Name"]),
            raw_table=qualified(config["Raw_Catalog"], config["Raw_Schema"], config["Entity_Name"]),
            raw_flag_text=config["Raw_Ingestion_Flag"],
            transformations=config["Transformations"],
            table_mode=(config["Table_Mode"] or "append").lower(),
            partition_column=config["Partition_Column"],
            audit_table=qualified(*audit, config["Audit_Table"]),
            ledger_table=qualified(*audit, f"{config['Audit_Table']}_files"),
            rules_table=qualified(*audit, f"{config['Audit_Table']}_rules"),
        )
