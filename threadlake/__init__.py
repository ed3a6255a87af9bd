"""threadlake: Spark-native analytics for threaded-discussion archives."""

from importlib import import_module

__version__ = "0.2.0"

#: Public names and the modules that hold them; each is imported when it is first asked for.
_HOMES = {
    "sources.archives": "ArchiveFile discover_archives get_months_in_range iter_archive_pairs parse_archive_filename",
    "sources.zst": "ReadProgress ZstReader count_records read_archives read_zst_lines read_zst_records write_archives",
    "sources.files": "CsvWriter JsonlWriter StreamingThreadWriter ThreadWriter",
    "plans.extract": "ExtractionResult ExtractionStats SubredditExtractor",
    "plans.archive_wide": "ArchiveCatalogue CrossSubIndex SearchResult SearchStats SubredditIndex WordSearcher assemble_search_results",
    "plans.community": "SignalDetector SubredditData SubredditMetadata TreeBuilder load_subreddit load_threads scan_threads",
    "operators.signals": "DepthDetector Detector RegexDetector RowDetector ScoreDetector get_detectors",
    "functions.text": "readable_duration readable_size setup_logging",
}
_HOME = {name: module for module, names in _HOMES.items() for name in names.split()}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)
