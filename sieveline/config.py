"""Options of a scan, read from YAML over defaults and checked."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from pathlib import Path

from sieveline.catalog import Signature, check, signatures

# Paths and extensions that are not scanned by default.
EXCLUDE_PATHS = (
    "vendor/** node_modules/** dist/** build/** out/** target/** bin/** .next/** .nuxt/** .yarn/** .git/** *.lock go.sum"
    " package-lock.json pnpm-lock.yaml yarn.lock **/locales/** **/i18n/** **/*.min.js **/*.min.css"
).split()
EXCLUDE_EXTENSIONS = (
    ".png .jpg .jpeg .gif .bmp .ico .svg .woff .woff2 .ttf .eot .mp4 .webm .mp3 .ogg .zip .tar .gz .bz2 .xz .7z .pdf .doc"
    " .docx .xls .xlsx .exe .dll .so .dylib .a .o .css .scss .csv .hex .eml .msg .mbox .vcf .ics .cache .pb.go .gen.go .g.go .map"
).split()
MAX_BYTES = 10 << 20
#: The public English word list of BIP-39, 2,048 words.
PHRASE_WORDS = tuple(Path(__file__).with_name("phrase_words.txt").read_text().split())


@dataclass(frozen=True)
class Config:
    entropy_threshold: float = 4.5
    min_secret_length: int = 20
    max_file_size_bytes: int = MAX_BYTES
    exclude_paths: tuple[str, ...] = tuple(EXCLUDE_PATHS)
    exclude_extensions: tuple[str, ...] = tuple(EXCLUDE_EXTENSIONS)
    allowlist_patterns: tuple[str, ...] = ()
    custom_signatures: tuple[Signature, ...] = ()
    patterns: bool = True
    entropy: bool = True
    context: bool = True
    fail_fast: bool = False
    #: A line with it is not scanned; if it is a comment, neither is the next.
    marker: str = "sieveline:ignore"
    #: Words of recovery phrases; with an empty tuple such phrases are not looked for.
    phrase_words: tuple[str, ...] = PHRASE_WORDS

    def __post_init__(self):
        if not 0 <= self.entropy_threshold <= 8:
            raise ValueError("entropy_threshold must be between 0 and 8")
        object.__setattr__(self, "min_secret_length", max(1, self.min_secret_length))
        if self.max_file_size_bytes < 0:
            object.__setattr__(self, "max_file_size_bytes", MAX_BYTES)
        object.__setattr__(self, "custom_signatures", tuple(check(s) for s in self.custom_signatures))

    def all_signatures(self) -> list[Signature]:
        return [*signatures(), *self.custom_signatures]


#: The switches of a file's disable_tiers and the options that they turn off.
TIERS = {"trie": "patterns", "patterns": "patterns", "entropy": "entropy", "context": "context"}


def from_mapping(given: dict, base: Config = Config()) -> Config:  # noqa: B008
    known = {f.name for f in fields(Config)}
    new = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known and k != "custom_signatures"}
    for k, v in (given.get("disable_tiers") or {}).items():
        new[TIERS[k]] = not v
    if "custom_signatures" in given:
        new["custom_signatures"] = tuple(Signature(s.get("id", ""), s.get("prefix", ""), s.get("severity", ""), s.get("regex", ""), s.get("description", "")) for s in given["custom_signatures"] or ())
    return replace(base, **new)


def load(path: str | None = None, name: str = ".sieveline.yaml") -> Config:
    """The named file, else that of the working folder, else that of the home folder, else the defaults."""
    places = [Path(path)] if path else [Path(name), Path.home() / name]
    for p in places:
        if p.exists():
            import yaml

            return from_mapping(yaml.safe_load(p.read_text()) or {})
    return Config()
