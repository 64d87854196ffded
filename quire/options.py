"""Parameters of the operators. They hold settings, never data."""

from __future__ import annotations

from dataclasses import dataclass

from quire import constants as C


@dataclass(frozen=True)
class PackOptions:
    """Settings of the scan, the content modes and the rendering."""

    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    respect_gitignore: bool = True
    show_line_numbers: bool = False
    compress: bool = False
    max_tokens: int | None = None
    tree_depth: int = C.TREE_DEPTH
    output_format: str = "default"  # default | markdown | cxml
    file_max_lines: int | None = None
    file_max_bytes: int | None = None
    max_file_bytes: int | None = None  # larger files are no text; None: any size
    data_sample_lines: int | None = None  # head of data files; None: whole files
    count_tokens: bool = True
    counter: str = "words"  # words | pretokens
    top_n: int = C.TOP_N
    escape_xml: bool = False

    def __post_init__(self) -> None:
        if self.output_format not in ("default", "markdown", "cxml"):
            raise ValueError(f"unknown output format {self.output_format!r}")


@dataclass(frozen=True)
class SnapshotOptions:
    """Settings stored in a snapshot header."""

    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    respect_gitignore: bool = True
    max_bytes: int = 0  # of stored contents; 0: any size
    max_lines: int = 0
