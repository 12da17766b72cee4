"""Settings of the document pipeline, checked when they are made.

Fixed values: the defaults are those that results depend on.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class ParserConfig:
    ocr_mode: str = "auto"
    ocr_language: str = "chi_sim+eng"
    ocr_dpi: int = 300
    min_native_text_chars: int = 30
    min_table_rows: int = 2
    min_table_columns: int = 2
    min_table_nonempty_ratio: float = 0.45
    min_table_quality_score: float = 0.52
    max_narrative_cell_chars: int = 160
    table_overlap_ratio: float = 0.72
    header_footer_zone_ratio: float = 0.08
    repeated_header_footer_ratio: float = 0.35
    min_repeated_header_footer_pages: int = 2
    max_block_vertical_gap_ratio: float = 1.8
    max_block_x_offset: float = 18.0
    merge_cross_page_continuations: bool = True
    code_indent_spaces: int = 4
    code_min_marker_lines: int = 2
    detect_complex_layout: bool = True
    complex_layout_strategy: str = "keep"
    complex_layout_min_blocks: int = 5
    complex_layout_short_block_chars: int = 24
    complex_layout_short_block_ratio: float = 0.5
    complex_layout_min_x_spread_ratio: float = 0.28
    detect_toc_pages: bool = True
    index_toc_pages: bool = False
    toc_min_numbered_entries: int = 6
    toc_max_average_entry_chars: float = 42
    heading_max_chars: int = 80
    single_level_heading_max_chars: int = 38
    heading_min_font_ratio: float = 1.12
    heading_bold_min_font_ratio: float = 1.04
    revalidate_headings_in_structure: bool = True

    def __post_init__(self):
        _need(self.ocr_mode in ("auto", "always", "never"), "ocr_mode is auto, always or never")
        _need(self.complex_layout_strategy in ("keep", "skip"), "complex_layout_strategy is keep or skip")
        _need(0 <= self.header_footer_zone_ratio < 0.5, "header_footer_zone_ratio lies in [0, 0.5)")
        _need(0 < self.repeated_header_footer_ratio <= 1, "repeated_header_footer_ratio lies in (0, 1]")
        _need(self.min_repeated_header_footer_pages >= 1 and self.code_indent_spaces >= 1, "counts are at least 1")


@dataclass(frozen=True)
class ChunkConfig:
    min_tokens: int = 180
    target_tokens: int = 500
    max_tokens: int = 800
    overlap_tokens: int = 80
    boundary_lookback_units: int = 24
    semantic_weight: float = 1.0
    length_weight: float = 0.35
    same_group_break_penalty: float = 1.25
    include_source_prefix: bool = True

    def __post_init__(self):
        _need(0 < self.min_tokens <= self.target_tokens <= self.max_tokens, "0 < min_tokens <= target_tokens <= max_tokens")
        _need(0 <= self.overlap_tokens < self.max_tokens, "overlap_tokens lies below max_tokens")
        _need(self.boundary_lookback_units >= 2, "boundary_lookback_units is at least 2")


@dataclass(frozen=True)
class SemanticConfig:
    backend: str = "hashing"
    hashing_dimensions: int = 1024
    batch_size: int = 32

    def __post_init__(self):
        _need(self.hashing_dimensions >= 16, "hashing_dimensions is at least 16")


@dataclass(frozen=True)
class QualityConfig:
    max_duplicate_ratio: float = 0.05
    max_ocr_ratio: float = 0.80
    max_short_child_ratio: float = 0.10
    max_under_min_ratio: float = 0.25
    max_single_child_parent_ratio: float = 0.60
    max_mid_sentence_ratio: float = 0.03
    max_broken_line_ratio: float = 0.10
    max_flat_path_ratio: float = 0.95
    max_suspicious_heading_ratio: float = 0.12
    max_malformed_code_ratio: float = 0.15
    max_ast_failure_ratio: float = 0.35
    max_indentation_issue_ratio: float = 0.20
    max_split_identifier_ratio: float = 0.10
    max_boundary_violation_ratio: float = 0.10
    max_glued_list_ratio: float = 0.03
    fail_on_error: bool = False


@dataclass(frozen=True)
class PipelineConfig:
    parser: ParserConfig = field(default_factory=ParserConfig)
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    semantic: SemanticConfig = field(default_factory=SemanticConfig)
    quality: QualityConfig = field(default_factory=QualityConfig)

    @classmethod
    def from_dict(cls, data: dict) -> PipelineConfig:
        """Unknown names raise."""
        kinds = {"parser": ParserConfig, "chunk": ChunkConfig, "semantic": SemanticConfig, "quality": QualityConfig}
        unknown = set(data) - {f.name for f in fields(cls)}
        _need(not unknown, f"unknown settings: {sorted(unknown)}")
        return cls(**{k: kinds[k](**v) for k, v in data.items()})

    @classmethod
    def from_json(cls, text: str) -> PipelineConfig:
        return cls.from_dict(json.loads(text))

    def to_dict(self) -> dict:
        return asdict(self)
