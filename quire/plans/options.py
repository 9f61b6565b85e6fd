"""Options of a translation run."""

from __future__ import annotations

from dataclasses import dataclass, field

from quire.operators.segment import Rules


@dataclass(frozen=True)
class Options:
    lang_in: str = "en"
    lang_out: str = "zh"
    service: str = "google"
    #: Page numbers from 0; none means every page.
    pages: tuple[int, ...] | None = None
    threads: int = 4
    ignore_cache: bool = False
    template: str | None = None
    rules: Rules = field(default_factory=Rules)
    page_width: float = 480.0
    page_height: float = 792.0

    def __post_init__(self) -> None:
        if self.threads < 1:
            raise ValueError("threads is 1 or more")
        if not self.service:
            raise ValueError("a service is needed")
