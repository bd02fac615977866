"""Extraction options."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """Limits and switches of an extraction; sizes in bytes, times in seconds."""

    render_word_pages: bool = True
    max_file_size: int = 512 << 20
    max_members: int = 100_000
    max_expanded: int = 2 << 30
    max_member: int = 1 << 30
    libreoffice_timeout: int = 180
    pdf_password: str | None = None
    json_indent: int = 2
    extract_assets: bool = True
    output_format: str = "both"

    def __repr__(self) -> str:
        return f"Options(max_file_size={self.max_file_size}, max_members={self.max_members}, password={'set' if self.pdf_password else 'none'})"
