"""Commands on volumes: python -m tidering.cli inspect|verify|dump|format PATH ...

Exit codes: 0 complete, 1 usage, 2 the volume can't be opened or asked that, 3 complete
but with gaps, 4 the output failed.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

from .errors import RingError
from .sources import media as M
from .sources.storage import FileStorage
from .sources.volume import Snapshot, format_volume


_NUMBER = re.compile(r"([+-]?)(0[xX][0-9a-fA-F]+|0[0-7]*|[1-9][0-9]*)")


def signed(text: str) -> int:
    """A whole number of 64 bits in decimal, 0x hexadecimal or 0 octal, and nothing else."""
    m = _NUMBER.fullmatch(text.strip(" \t"))
    if not m:
        raise argparse.ArgumentTypeError(f"{text!r} is no number")
    digits = m[2]
    value = int(digits, 16 if digits[:2] in ("0x", "0X") else 8 if digits[0] == "0" else 10) * (-1 if m[1] == "-" else 1)
    if not -(1 << 63) <= value < 1 << 63:
        raise argparse.ArgumentTypeError(f"{text} is out of range")
    return value


def unsigned(text: str) -> int:
    if text.lstrip(" \t").startswith("-"):
        raise argparse.ArgumentTypeError(f"{text} is negative")
    m = _NUMBER.fullmatch(text.strip(" \t"))
    if not m:
        raise argparse.ArgumentTypeError(f"{text!r} is no number")
    digits = m[2]
    value = int(digits, 16 if digits[:2] in ("0x", "0X") else 8 if digits[0] == "0" else 10)
    if value > M.U64:
        raise argparse.ArgumentTypeError(f"{text} is out of range")
    return value


def preview(data: bytes, most: int = 64) -> str:
    return data[:most].hex() + ("..." if len(data) > most else "")


def inspect(args, out) -> int:
    snap = Snapshot(FileStorage(args.path))
    v = snap.volume
    print(f"volume {v.id} size={v.volume_size} partitions={v.partition_count} partition_size={v.partition_size} index={v.index_region_size} block={v.max_block_payload} quantum={v.persistence_quantum} created={v.created_time_ns}", file=out)
    for s in snap.states:
        p, o = s.partition, s.partition.options
        n = s.footer["block_count"] if s.sealed else len(s.index)
        print(f"slot={p.slot} generation={p.generation} {'sealed' if s.sealed else 'active'} blocks={n} bytes={s.data_end - M.REGION} codec={o.compression}:{o.compression_version} profile={o.record_format_id:#x}:{o.record_format_version} domain={o.time_domain_id}", file=out)
    return 3 if snap.damaged else 0


def verify(args, out) -> int:
    blocks = records = raw = gaps = 0
    for e in Snapshot(FileStorage(args.path), strict=args.strict).events():
        if e.kind != "data":
            gaps += 1
            continue
        o = e.partition.options
        blocks, raw = blocks + 1, raw + len(e.data)
        if (o.record_format_id, o.record_format_version) == M.FRAMED_PROFILE:
            records += len(M.frame_decode(e.data))
    print(f"blocks={blocks} records={records} raw_bytes={raw} gaps={gaps}", file=out)
    return 3 if gaps else 0


def dump(args, out) -> int:
    ranged = args.begin is not None or args.end is not None
    if args.selector and not args.framed or ranged and args.time_domain is None:
        raise RingError("invalid_argument", "selectors need --framed, a range needs --time-domain")
    begin = args.begin if args.begin is not None else -(1 << 63)
    end = args.end if args.end is not None else (1 << 63) - 1
    gaps, wanted = 0, set(args.selector or ())
    events = Snapshot(FileStorage(args.path)).events(*((begin, end) if ranged else (None, None)), args.time_domain)
    for e in events:
        if e.kind != "data":
            gaps += 1
            print(f"gap {e.kind} slot={e.slot} generation={e.generation}", file=sys.stderr)
        elif args.raw_blocks:
            out.buffer.write(len(e.data).to_bytes(4, "little") + e.data)
        elif args.framed:
            o = e.partition.options
            if (o.record_format_id, o.record_format_version) != M.FRAMED_PROFILE:
                raise RingError("unsupported", "a block of another profile")
            for t, selector, flags, payload, _ in M.frame_decode(e.data):
                if (not ranged or begin <= t < end) and (not wanted or selector in wanted):
                    print(f"{e.generation} {e.block['sequence']} {t} {selector} {flags} {preview(payload)}", file=out)
        else:
            b = e.block
            print(f"{e.generation} {b['sequence']} records={b['record_count']} time=[{b['min_time_ns']},{b['max_time_ns']}] flags={b['flags']:#x} {preview(e.data)}", file=out)
    out.flush()
    return 3 if gaps else 0


def format_(args, out) -> int:
    if os.path.exists(args.path) and not os.path.isfile(args.path):
        raise RingError("unsupported", "only regular files are formatted")
    s = FileStorage.create(args.path, args.size, args.overwrite)
    try:
        v = format_volume(s, args.partition_size, args.index_size, args.block, args.quantum, args.created)
    finally:
        s.close()
    print(f"volume {v.id} partitions={v.partition_count}", file=out)
    return 0


def main(argv: list[str] | None = None, out=None) -> int:
    parser = argparse.ArgumentParser(prog="tidering", exit_on_error=False)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run in (("inspect", inspect), ("verify", verify), ("dump", dump), ("format", format_)):
        p = commands.add_parser(name, exit_on_error=False)
        p.add_argument("path")
        p.set_defaults(run=run)
        if name == "verify":
            p.add_argument("--strict", action="store_true")
        elif name == "dump":
            p.add_argument("--from", dest="begin", type=signed)
            p.add_argument("--to", dest="end", type=signed)
            p.add_argument("--selector", type=unsigned, action="append")
            p.add_argument("--time-domain", type=unsigned)
            p.add_argument("--framed", action="store_true")
            p.add_argument("--raw-blocks", action="store_true")
        elif name == "format":
            p.add_argument("--size", type=unsigned, required=True)
            p.add_argument("--partition-size", type=unsigned, default=4 << 20)
            p.add_argument("--index-size", type=unsigned, default=256 << 10)
            p.add_argument("--block", type=unsigned, default=32 << 10)
            p.add_argument("--quantum", type=unsigned, default=4096)
            p.add_argument("--created", type=signed, default=0)
            p.add_argument("--overwrite", action="store_true")
    try:
        args = parser.parse_args(argv)
    except (argparse.ArgumentError, SystemExit) as e:
        print(e, file=sys.stderr)
        return 1
    try:
        return args.run(args, out or sys.stdout)
    except RingError as e:
        print(e, file=sys.stderr)
        return 2
    except OSError as e:
        print(e, file=sys.stderr)
        return 4


if __name__ == "__main__":
    sys.exit(main())
