"""Command line: python -m threadlake COMMAND."""

from __future__ import annotations

import argparse
import logging
import sys

from .functions.text import readable_size, setup_logging

_RANGE = (("--start-month", {}), ("--end-month", {}))
_ARCHIVE = (("--archive", {"required": True}), ("--output", {"required": True}))
#: name: help, and (argument, settings) of each.
COMMANDS: dict[str, tuple[str, tuple]] = {
    "extract": ("extract communities from archives", (*_ARCHIVE, ("--subreddits", {"nargs": "+", "required": True}), ("--format", {"choices": ("csv", "jsonl", "both"), "default": "both"}), *_RANGE, ("--include", {"nargs": "+"}), ("--exclude", {"nargs": "+"}), ("--force", {"action": "store_true"}), ("--workers", {"type": int, "default": 1}))),
    "build-trees": ("build the threads of an extracted community", (("path", {}), ("--month", {}), ("--db", {}))),
    "info": ("describe an extracted community", (("path", {}),)),
    "catalogue": ("count records and authors by community and month", (*_ARCHIVE, *_RANGE, ("--min-activity", {"type": int, "default": 1}))),
    "subreddit-index": ("index the communities of archives", (*_ARCHIVE, *_RANGE, ("--min-records", {"type": int, "default": 1}))),
    "cross-sub-index": ("find authors active in several extracted communities", (("--extracted", {"required": True}), ("--subreddits", {"nargs": "+"}), ("--output", {"required": True}), ("--min-subreddits", {"type": int, "default": 2}))),
    "search": ("search archives for a pattern", (*_ARCHIVE, ("--pattern", {"required": True}), ("--case-sensitive", {"action": "store_true"}), ("--format", {"choices": ("csv", "jsonl", "both"), "default": "jsonl"}), *_RANGE, ("--force", {"action": "store_true"}), ("--assemble", {"action": "store_true"}))),
    "signals": ("run a preset of detectors over an extracted community", (("path", {}), ("--preset", {"default": "general"}), ("--month", {}))),
    "graph": ("export the graphs of an extracted community", (("path", {}), ("--output", {"required": True}), ("--month", {}))),
    "list-archives": ("list archives", (("path", {}), ("--comments-dir", {"default": "comments"}), ("--submissions-dir", {"default": "submissions"}))),
}
_SHORT = {"--archive": "-a", "--output": "-o", "--subreddits": "-s", "--format": "-f", "--workers": "-w", "--month": "-m", "--extracted": "-e", "--pattern": "-p"}


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-v", "--verbose", action="store_true", default=argparse.SUPPRESS)
    common.add_argument("-q", "--quiet", action="store_true", default=argparse.SUPPRESS)
    top = argparse.ArgumentParser(prog="threadlake", parents=[common])
    commands = top.add_subparsers(dest="command")
    for name, (about, arguments) in COMMANDS.items():
        sub = commands.add_parser(name, help=about, parents=[common])
        for flag, settings in arguments:
            sub.add_argument(*([_SHORT[flag]] if flag in _SHORT else []), flag, **settings)
    return top


def run(args: argparse.Namespace) -> dict:
    """The command's result as a dictionary."""
    from .plans import archive_wide, community, extract
    from .sources.archives import discover_archives

    span = {"start_month": getattr(args, "start_month", None), "end_month": getattr(args, "end_month", None)}
    if args.command == "extract":
        r = extract.SubredditExtractor(args.archive, args.output, args.subreddits, args.format, include_patterns=args.include, exclude_patterns=args.exclude, force=args.force, workers=args.workers).run(**span)
        return {"communities": ", ".join(r.subreddits), "months": r.months_processed, "submissions": r.total_submissions, "comments": r.total_comments}
    if args.command == "build-trees":
        b = community.TreeBuilder(args.path, args.db)
        built = {args.month: b.build_month(args.month)} if args.month else b.build_all_months()
        return {"threads": sum(built.values()), "months": len(built)}
    if args.command == "info":
        d = community.load_subreddit(args.path)
        out = {"community": d.subreddit, "months": len(d.months), "first": d.months[0] if d.months else "", "last": d.months[-1] if d.months else "", "submissions": d.metadata.total_submissions, "comments": d.metadata.total_comments}
        if getattr(args, "verbose", False):
            out |= {m: f"{s.get('submissions_count')} submissions, {s.get('comments_count')} comments" for m in d.months for s in [d.month_stats(m)]}
        return out
    if args.command == "catalogue":
        return archive_wide.ArchiveCatalogue(args.archive, args.output).run(**span, min_activity=args.min_activity)
    if args.command == "subreddit-index":
        return archive_wide.SubredditIndex(args.archive, args.output).run(**span, min_records=args.min_records)
    if args.command == "cross-sub-index":
        return archive_wide.CrossSubIndex.from_directory(args.extracted, args.subreddits).build(args.min_subreddits).save(args.output)
    if args.command == "search":
        s = archive_wide.WordSearcher(args.archive, args.output, args.pattern, args.case_sensitive, output_format=args.format, force=args.force)
        r = s.run(**span)
        return {"months": r.months_processed, "comments": r.total_comments, "submissions": r.total_submissions} | ({f"assembled {k}": v for k, v in s.assemble_results().items()} if args.assemble else {})
    if args.command == "signals":
        from .operators.signals import get_detectors

        d = community.SignalDetector(args.path, get_detectors(args.preset))
        return {args.month: d.run_month(args.month)} if args.month else d.run_all_months()
    if args.command == "graph":
        d = community.load_subreddit(args.path)
        return {f"comment {k}": v for k, v in d.export_comment_graph(args.output, args.month).items()} | {f"author {k}": v for k, v in d.export_author_graph(args.output, args.month).items()}
    found = discover_archives(args.path, args.comments_dir, args.submissions_dir)
    out = {kind: sum(a.file_type == kind for a in found) for kind in ("comments", "submissions")}
    if found:
        out |= {"first": found[0].month_str, "last": found[-1].month_str}
    if getattr(args, "verbose", False):
        out |= {a.path.name: readable_size(a.path.stat().st_size) for a in found}
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    setup_logging(logging.DEBUG if getattr(args, "verbose", False) else logging.WARNING if getattr(args, "quiet", False) else logging.INFO)
    if not args.command:
        parser().print_help()
        return 1
    for k, v in run(args).items():
        print(f"{k}: {v:,}" if isinstance(v, int) else f"{k}: {v}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
