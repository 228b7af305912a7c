"""Capture files (pcap and pcapng) as tables: a data source that streams each file through one task and decodes it itself."""

from __future__ import annotations

import socket
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import RAW_PACKETS

NAMES = "host string, ip string, ts double"
#: Rows of a batch that a task gives to Spark.
BATCH = 8192
#: Longest frame that is read; a larger length means that the file is damaged from there on.
LONGEST = 1 << 26
# Fixed values of the formats: link types, EtherTypes and IP protocols.
ETHERNET, NULL, RAW, SLL, SLL2, IPV4, IPV6 = 1, 0, 101, 113, 276, 228, 229
TYPE_IP, TYPE_ARP, TYPE_IP6, TYPES_VLAN = 0x0800, 0x0806, 0x86DD, (0x8100, 0x88A8)
TCP, UDP = 6, 17
IP_PROTOCOLS = {1: "ICMP", 2: "IGMP", 58: "ICMPv6"}
UDP_PORTS = {53: "DNS", 67: "DHCP", 68: "DHCP", 123: "NTP", 1900: "SSDP", 3478: "STUN", 5353: "MDNS"}
TCP_PORTS = {53: "DNS", 1883: "MQTT", 8883: "MQTT"}
TLS_VERSIONS = {0x0300: "SSLv3", 0x0301: "TLSv1", 0x0302: "TLSv1.1", 0x0303: "TLSv1.2", 0x0304: "TLSv1.3"}
HTTP_STARTS = (b"GET ", b"POST ", b"PUT ", b"HEAD ", b"DELETE ", b"OPTIONS ", b"PATCH ", b"HTTP/1.")


@dataclass
class Frame:
    """One record of a capture: its time, link type, length on the wire and the octets kept."""

    ts: float | None
    link: int
    length: int
    data: bytes


@dataclass
class Packet:
    """What the layers of a frame say; fields of layers that it lacks are None."""

    protocol: str
    mac: str | None = None
    src: str | None = None
    dst: str | None = None
    ip_protocol: int | None = None
    transport: int | None = None
    sport: int | None = None
    dport: int | None = None
    seq: int = 0
    ack: int = 0
    flags: int = 0
    window: int = 0
    payload: bytes = b""
    n_payload: int = 0
    ends: tuple | None = None


def frames(f: BinaryIO) -> Iterator[Frame]:
    """Records of a pcap or pcapng file in order.

    A file that ends, or stops making sense, inside a record gives the records
    before it; one that is neither format, or is empty, gives none.
    """
    head = f.read(4)
    if head == b"\x0a\x0d\x0d\x0a":
        yield from _blocks(f, head)
        return
    kinds = {b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\x3c\x4d": (">", 1e9), b"\x4d\x3c\xb2\xa1": ("<", 1e9)}
    rest = f.read(20)
    if head not in kinds or len(rest) < 20:
        return
    order, unit = kinds[head]
    link = struct.unpack(order + "I", rest[16:])[0] & 0x0FFFFFFF
    while len(record := f.read(16)) == 16:
        seconds, part, kept, length = struct.unpack(order + "IIII", record)
        data = f.read(kept) if kept <= LONGEST else b""
        if kept > LONGEST or len(data) < kept:
            return
        yield Frame(seconds + part / unit, link, length, data)


def _blocks(f: BinaryIO, head: bytes) -> Iterator[Frame]:
    order, faces = "<", []
    while len(head) == 4:
        size = f.read(4)
        if len(size) < 4:
            return
        if head == b"\x0a\x0d\x0d\x0a":  # a section: the order of its octets comes after its size
            magic = f.read(4)
            order, faces = (">" if magic == b"\x1a\x2b\x3c\x4d" else "<"), []
            total, kind, taken = struct.unpack(order + "I", size)[0], 0, 12
            if magic not in (b"\x1a\x2b\x3c\x4d", b"\x4d\x3c\x2b\x1a"):
                return
        else:
            total, kind, taken = struct.unpack(order + "I", size)[0], struct.unpack(order + "I", head)[0], 8
        left = total - taken
        if left < 4 or total > LONGEST:
            return
        body = f.read(left)
        if len(body) < left:
            return
        body = body[:-4]
        if kind == 1 and len(body) >= 8:
            faces.append((struct.unpack(order + "H", body[:2])[0], _resolution(body[8:], order)))
        elif kind == 6 and len(body) >= 20:
            face, high, low, kept, length = struct.unpack(order + "IIIII", body[:20])
            if face < len(faces) and kept <= len(body) - 20:
                link, unit = faces[face]
                yield Frame(((high << 32) | low) / unit, link, length, body[20 : 20 + kept])
        elif kind == 3 and len(body) >= 4 and faces:
            length = struct.unpack(order + "I", body[:4])[0]
            yield Frame(None, faces[0][0], length, body[4 : 4 + length])
        head = f.read(4)


def _resolution(options: bytes, order: str) -> float:
    """Units of time in a second, by an interface's option 9; a million without it."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 9 and size == 1 and at + 4 < len(options):
            value = options[at + 4]
            return float(2 ** (value & 127) if value & 128 else 10**value)
        if code == 0:
            break
        at += 4 + size + -size % 4
    return 1e6


def decode(frame: Frame) -> Packet:
    """The layers of a frame. Cut headers give what came before them; an unknown link type gives ``LINK-`` and its number."""
    data, mac = frame.data, None
    if frame.link == ETHERNET:
        if len(data) < 14:
            return Packet("ETHERNET")
        mac, kind, at = data[:6].hex(":"), int.from_bytes(data[12:14]), 14
        while kind in TYPES_VLAN and len(data) >= at + 4:
            kind, at = int.from_bytes(data[at + 2 : at + 4]), at + 4
    elif frame.link in (SLL, SLL2):
        at = 16 if frame.link == SLL else 20
        kind = int.from_bytes(data[14:16] if frame.link == SLL else data[0:2])
    elif frame.link in (RAW, IPV4, IPV6, NULL):
        at = 4 if frame.link == NULL else 0
        kind = {4: TYPE_IP, 6: TYPE_IP6}.get(data[at] >> 4 if len(data) > at else 0, 0)
    else:
        return Packet(f"LINK-{frame.link}")
    body = data[at:]
    if kind == TYPE_IP and len(body) >= 20:
        size, total, transport = (body[0] & 15) * 4, int.from_bytes(body[2:4]), body[9]
        src, dst = socket.inet_ntoa(body[12:16]), socket.inet_ntoa(body[16:20])
        packet = Packet(IP_PROTOCOLS.get(transport, "IPv4"), mac, src, dst, transport, transport)
        if not int.from_bytes(body[6:8]) & 0x1FFF:  # later fragments have no ports
            # A total of 0 comes from offloaded segments: all that follows belongs to the packet.
            _transport(packet, body[size : total or None], (total or len(body)) - size, (body[12:16], body[16:20]))
        return packet
    if kind == TYPE_IP6 and len(body) >= 40:
        packet = Packet(IP_PROTOCOLS.get(body[6], "IPv6"), mac, transport=body[6])
        total = int.from_bytes(body[4:6])
        _transport(packet, body[40 : 40 + total], total, (body[8:24], body[24:40]))
        return packet
    return Packet("ARP" if kind == TYPE_ARP else "ETHERNET" if mac else "UNKNOWN", mac)


def _transport(p: Packet, body: bytes, length: int, hosts: tuple[bytes, bytes]) -> None:
    if p.transport == TCP and len(body) >= 20:
        p.sport, p.dport, p.seq, p.ack = struct.unpack(">HHII", body[:12])
        size, p.flags, p.window = (body[12] >> 4) * 4, body[13], int.from_bytes(body[14:16])
        p.payload, p.n_payload = body[size:], max(0, length - size)
        p.protocol = _stream_protocol(p)
    elif p.transport == UDP and len(body) >= 8:
        p.sport, p.dport = struct.unpack(">HH", body[:4])
        p.payload, p.n_payload = body[8:], max(0, length - 8)
        named = UDP_PORTS.get(p.dport) or UDP_PORTS.get(p.sport)
        quic = 443 in (p.sport, p.dport) and p.payload and p.payload[0] & 0x40
        p.protocol = named or ("QUIC" if quic else "UDP")
    else:
        return
    p.ends = ((hosts[0], p.sport), (hosts[1], p.dport))


def _stream_protocol(p: Packet) -> str:
    head = p.payload[:5]
    if len(head) == 5 and 20 <= head[0] <= 23 and head[1] == 3:
        return TLS_VERSIONS.get(int.from_bytes(head[1:3]), "TLSv1.2")
    if p.payload.startswith(HTTP_STARTS):
        return "HTTP"
    return (TCP_PORTS.get(p.dport) or TCP_PORTS.get(p.sport) or "TCP") if p.payload else "TCP"


class Conversations:
    """Numbers the TCP and UDP conversations of a file and marks repeats; holds one small state for each direction."""

    def __init__(self):
        self.numbers: dict[int, dict] = {TCP: {}, UDP: {}}
        self.ways: dict[tuple, list] = {}

    def see(self, p: Packet) -> tuple[int | None, str]:
        """Stream number and expert mark of a packet."""
        if p.ends is None:
            return None, ""
        numbers = self.numbers[p.transport]
        number = numbers.setdefault(tuple(sorted(p.ends)), len(numbers))
        return number, self._mark(p) if p.transport == TCP else ""

    def _mark(self, p: Packet) -> str:
        if p.flags & 0x04:  # a reset starts anew
            self.ways.pop(p.ends, None)
            return ""
        used = p.n_payload + (p.flags & 0x02 != 0) + (p.flags & 0x01)
        way = self.ways.get(p.ends)
        if way is None or p.flags & 0x12 == 0x02 and (p.seq + 1) & 0xFFFFFFFF != way[0]:
            self.ways[p.ends] = [(p.seq + used) & 0xFFFFFFFF, p.ack, p.window, 0]
            return ""
        ahead = (p.seq + used - way[0]) & 0xFFFFFFFF
        if used and (ahead == 0 or ahead >= 1 << 31):
            return "TCP retransmission" if p.n_payload != 1 or p.flags & 0x03 else "TCP keep-alive"
        same = not used and p.ack == way[1] and p.window == way[2] and p.seq == way[0]
        way[3] = way[3] + 1 if same else 0
        if used:
            way[0] = (p.seq + used) & 0xFFFFFFFF
        way[1], way[2] = p.ack, p.window
        return f"Duplicate ACK #{way[3]}" if way[3] else ""


def dns_answers(message: bytes) -> tuple[str, list[str]]:
    """The name asked for and the IPv4 addresses of an answer; damaged messages give what comes before the damage."""
    if len(message) < 12 or not message[2] & 0x80:
        return "", []
    asked, answers = struct.unpack(">HH", message[4:8])
    host, addresses, at = "", [], 12
    try:
        for i in range(asked):
            name, at = _name(message, at)
            host, at = (name if i == 0 else host), at + 4
        for _ in range(answers):
            _, at = _name(message, at)
            kind, _, _, size = struct.unpack_from(">HHIH", message, at)
            at += 10
            if kind == 1 and size == 4 and at + 4 <= len(message):
                addresses.append(socket.inet_ntoa(message[at : at + 4]))
            at += size
    except (struct.error, ValueError):
        pass
    return host, addresses


def _name(message: bytes, at: int) -> tuple[str, int]:
    """A name, whose tail may be a pointer to an earlier one, and where the message goes on; pointers must lead back."""
    labels, after, least = [], None, at
    while True:
        if at >= len(message):
            raise ValueError("name runs off the message")
        size = message[at]
        if size >= 0xC0:
            to = int.from_bytes(message[at : at + 2]) & 0x3FFF
            after = at + 2 if after is None else after
            if to >= least:
                raise ValueError("pointer leads forward")
            at = least = to
        elif size == 0:
            return ".".join(labels), at + 1 if after is None else after
        elif size >= 0x40 or at + 1 + size > len(message):
            raise ValueError("no label")
        else:
            labels.append(message[at + 1 : at + 1 + size].decode("latin-1"))
            at += 1 + size


def server_name(payload: bytes) -> str:
    """The server name of a TLS client's first message, if its record has come that far; else empty."""
    if len(payload) < 6 or payload[0] != 22 or payload[1] != 3 or payload[5] != 1:
        return ""
    try:
        at = 5 + 4 + 2 + 32  # record, handshake, version, random
        at += 1 + payload[at]
        at += 2 + int.from_bytes(payload[at : at + 2])
        at += 1 + payload[at]
        end = at + 2 + int.from_bytes(payload[at : at + 2])
        at += 2
        while at + 4 <= min(end, len(payload)):
            kind, size = struct.unpack_from(">HH", payload, at)
            if kind == 0 and size >= 5 and at + 4 + size <= len(payload):
                n = int.from_bytes(payload[at + 7 : at + 9])
                return payload[at + 9 : at + 9 + n].decode("latin-1")
            at += 4 + size
    except IndexError:
        pass
    return ""


def packet_rows(f: BinaryIO) -> Iterator[tuple]:
    """Rows of ``RAW_PACKETS``: frames count from 1, ts_delta is the time since the frame before, addresses are IPv4 only."""
    before, seen = None, Conversations()
    for number, frame in enumerate(frames(f), 1):
        p = decode(frame)
        stream, mark = seen.see(p)
        delta = 0.0 if before is None or frame.ts is None else round(frame.ts - before, 9)
        before = frame.ts if frame.ts is not None else before
        yield number, frame.ts, delta, frame.length, p.protocol, stream, p.src, p.dst, p.sport, p.dport, p.ip_protocol, p.mac, mark


def name_rows(f: BinaryIO) -> Iterator[tuple]:
    """host, ip and ts of every address in a DNS answer and of every server that a TLS client names."""
    for frame in frames(f):
        p = decode(frame)
        if not p.payload or frame.ts is None:
            continue
        found: list[tuple[str, str]] = []
        if 53 in (p.sport, p.dport):
            host, addresses = dns_answers(p.payload[2:] if p.transport == TCP else p.payload)
            found = [(host, a) for a in addresses]
        elif p.transport == TCP and p.dst:
            found = [(server_name(p.payload), p.dst)]
        yield from ((host.lower(), ip, frame.ts) for host, ip in found if host and not host.startswith("192.168."))


@dataclass
class CaptureFile(InputPartition):
    path: str
    device: str
    activity: str


class CaptureReader(DataSourceReader):
    def __init__(self, path: str, names: bool, columns: list[tuple[str, str]]):
        self.path, self.names, self.columns = path, names, columns

    def partitions(self) -> list[CaptureFile]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
        paths = sorted(i.path for i in files if i.is_file and i.path.endswith((".pcap", ".pcapng", ".cap")))
        above = lambda p, k: ([""] * 3 + p.split("/"))[-1 - k]
        return [CaptureFile(p, above(p, 1 if self.names else 2), "" if self.names else above(p, 1)) for p in paths]

    def read(self, partition: CaptureFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file at all
            return
        fs = pyarrow.fs.FileSystem.from_uri(self.path)[0]
        types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
        schema = pa.schema([(n, types[t]) for n, t in self.columns])
        own = (partition.device,) if self.names else (partition.device, partition.activity)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        with fs.open_input_stream(partition.path, buffer_size=1 << 20) as f:
            held: list[tuple] = []
            for row in name_rows(f) if self.names else packet_rows(f):
                held.append(row + own)
                if len(held) == BATCH:
                    yield batch(held)
                    held = []
            if held:
                yield batch(held)


class CaptureSource(DataSource):
    """Format ``capture``: option path is a folder or file in any store that pyarrow opens, option kind is packets or names."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return NAMES + ", device string" if self._names else RAW_PACKETS + ", device string, activity string"

    @property
    def _names(self) -> bool:
        return self.options.get("kind", "packets") == "names"

    def reader(self, schema) -> CaptureReader:
        path = self.options["path"]
        return CaptureReader(path if "://" in path else "file://" + path, self._names, [tuple(c.split(" ")) for c in self.schema().split(", ")])


def _load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").option("path", path).option("kind", kind).load()


def packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets of all captures below a path, with the columns of ``readers.packets(raw=True)``; those without a time are dropped.

    A file is read by one task, a batch at a time; what that task holds grows
    with the conversations of the file, not with its packets.
    """
    return _load(spark, path, "packets").withColumn("activity", F.regexp_replace("activity", "2$", "")).where("ts is not null")


def name_history(spark: SparkSession, path: str) -> DataFrame:
    """(device, ip, host, ts) from DNS answers and TLS server names of all captures, one folder for each device."""
    return _load(spark, path, "names").select("device", "ip", "host", "ts")
