from __future__ import annotations

import io
import socket
import struct

import pytest

from flowlens.operators import flows, lookups
from flowlens.sources import captures, readers

A, B, DNS = "192.168.10.5", "52.94.1.10", "8.8.8.8"


def ip4(proto, src, dst, body, fragment=0):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 7, fragment, 64, proto, 0, socket.inet_aton(src), socket.inet_aton(dst)) + body


def tcp(sport, dport, seq, ack, flags, payload=b"", window=100):
    return struct.pack(">HHIIBBHHH", sport, dport, seq, ack, 0x50, flags, window, 0, 0) + payload


def udp(sport, dport, payload):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def ether(body, kind=0x0800, vlan=False):
    return bytes.fromhex("aabbccddeeff112233445566") + (struct.pack(">HH", 0x8100, 5) if vlan else b"") + struct.pack(">H", kind) + body


def dns_answer(host, addresses):
    name = b"".join(bytes([len(x)]) + x.encode() for x in host.split(".")) + b"\0"
    alias = b"\xc0\x0c" + struct.pack(">HHIH", 5, 1, 60, 4) + b"\x01x\xc0\x0c"
    return struct.pack(">HHHHHH", 1, 0x8180, 1, 1 + len(addresses), 0, 0) + name + struct.pack(">HH", 1, 1) + alias + b"".join(b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + socket.inet_aton(a) for a in addresses)


def hello(host):
    names = struct.pack(">HBH", len(host) + 3, 0, len(host)) + host.encode()
    extensions = struct.pack(">HH", 10, 2) + b"\0\0" + struct.pack(">HH", 0, len(names)) + names
    body = b"\x03\x03" + bytes(32) + b"\x02\x01\x02" + struct.pack(">H", 4) + bytes(4) + b"\x01\0" + struct.pack(">H", len(extensions)) + extensions
    return b"\x16\x03\x01" + struct.pack(">H", len(body) + 4) + b"\x01" + len(body).to_bytes(3) + body


FRAMES = [
    (1.5, ether(ip4(17, DNS, A, udp(53, 4000, dns_answer("Api.Example.com", [B, "52.94.1.11"]))))),
    (2.0, ether(ip4(6, A, B, tcp(40000, 443, 100, 0, 0x02)))),
    (2.25, ether(ip4(6, B, A, tcp(443, 40000, 900, 101, 0x12)))),
    (2.5, ether(ip4(6, A, B, tcp(40000, 443, 101, 901, 0x18, hello("cdn.example.net"))), vlan=True)),
    (2.75, ether(ip4(6, A, B, tcp(40000, 443, 101, 901, 0x18, hello("cdn.example.net"))))),
    (3.0, ether(ip4(6, B, A, tcp(443, 40000, 901, 101, 0x10)))),
    (3.0, ether(ip4(6, B, A, tcp(443, 40000, 901, 101, 0x10)))),
    (3.5, ether(ip4(17, A, B, udp(123, 123, b"x" * 48)))),
    (4.0, ether(ip4(1, A, B, b"\x08\0\0\0"))),
    (4.5, ether(b"\0" * 28, 0x0806)),
    (5.0, ether(bytes([0x60, 0, 0, 0]) + struct.pack(">HBB", 12, 17, 64) + bytes(32) + udp(5353, 5353, b"mdns"), 0x86DD)),
    (6.0, ether(ip4(17, A, B, b"late piece", fragment=10))),
    (7.0, ether(ip4(17, A, B, udp(50000, 443, b"\xc0quic")))),
]
WANT = [
    (1, 1.5, 0.0, "DNS", 0, DNS, A, 53, 4000, 17, ""),
    (2, 2.0, 0.5, "TCP", 0, A, B, 40000, 443, 6, ""),
    (3, 2.25, 0.25, "TCP", 0, B, A, 443, 40000, 6, ""),
    (4, 2.5, 0.25, "TLSv1", 0, A, B, 40000, 443, 6, ""),
    (5, 2.75, 0.25, "TLSv1", 0, A, B, 40000, 443, 6, "TCP retransmission"),
    (6, 3.0, 0.25, "TCP", 0, B, A, 443, 40000, 6, "Duplicate ACK #1"),
    (7, 3.0, 0.0, "TCP", 0, B, A, 443, 40000, 6, "Duplicate ACK #2"),
    (8, 3.5, 0.5, "NTP", 1, A, B, 123, 123, 17, ""),
    (9, 4.0, 0.5, "ICMP", None, A, B, None, None, 1, ""),
    (10, 4.5, 0.5, "ARP", None, None, None, None, None, None, ""),
    (11, 5.0, 0.5, "MDNS", 2, None, None, 5353, 5353, None, ""),
    (12, 6.0, 1.0, "IPv4", None, A, B, None, None, 17, ""),
    (13, 7.0, 1.0, "QUIC", 3, A, B, 50000, 443, 17, ""),
]


def pcap(frames, order="<", magic=0xA1B2C3D4, unit=10**6, link=1):
    out = struct.pack(order + "IHHIIII", magic, 2, 4, 0, 0, 65535, link)
    return out + b"".join(struct.pack(order + "IIII", int(t), round(t % 1 * unit), len(d), len(d) + 3) + d for t, d in frames)


def block(kind, body, order):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))


def pcapng(frames, order="<", resolution=9):
    section = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)
    face = block(1, struct.pack(order + "HHI", 1, 0, 0) + struct.pack(order + "HHB3x", 9, 1, resolution) + struct.pack(order + "HH", 0, 0), order)
    units = 10**resolution
    each = lambda t, d: block(6, struct.pack(order + "IIIII", 0, int(t * units) >> 32, int(t * units) & 0xFFFFFFFF, len(d), len(d) + 3) + d, order)
    return section + face + block(5, b"stat", order) + b"".join(each(t, d) for t, d in frames)


FORMS = {"little": pcap(FRAMES), "big": pcap(FRAMES, ">"), "nano": pcap(FRAMES, "<", 0xA1B23C4D, 10**9), "ng": pcapng(FRAMES), "ng_big": pcapng(FRAMES, ">", 6)}


@pytest.mark.parametrize("form", FORMS)
def test_forms_give_the_same_rows(form):
    got = list(captures.packet_rows(io.BytesIO(FORMS[form])))
    assert [(*r[:3], *r[4:11], r[12]) for r in got] == WANT
    assert [r[3] for r in got] == [len(d) + 3 for _, d in FRAMES] and {r[11] for r in got} == {"aa:bb:cc:dd:ee:ff"}
    assert list(captures.name_rows(io.BytesIO(FORMS[form]))) == [("api.example.com", B, 1.5), ("api.example.com", "52.94.1.11", 1.5), ("cdn.example.net", B, 2.5), ("cdn.example.net", B, 2.75)]


@pytest.mark.parametrize("form", FORMS)
def test_files_cut_anywhere_give_the_whole_records(form):
    whole = FORMS[form]
    full = list(captures.packet_rows(io.BytesIO(whole)))
    for end in range(0, len(whole), 7):
        part = list(captures.packet_rows(io.BytesIO(whole[:end])))
        assert part == full[: len(part)]
        list(captures.name_rows(io.BytesIO(whole[:end])))


def test_other_links_and_damage():
    inner = ip4(17, A, B, udp(1, 2, b"x"))
    for link, data in ((101, inner), (228, inner), (0, b"\2\0\0\0" + inner), (113, bytes(14) + b"\x08\0" + inner), (276, b"\x08\0" + bytes(18) + inner)):
        row = next(captures.packet_rows(io.BytesIO(pcap([(1.0, data)], link=link))))
        assert (row[4], row[6], row[7], row[8]) == ("UDP", A, B, 1), link
    assert next(captures.packet_rows(io.BytesIO(pcap([(1.0, b"abc")], link=147))))[4] == "LINK-147"
    assert list(captures.packet_rows(io.BytesIO(b"no capture at all, but long enough for a header"))) == []
    damaged = pcap(FRAMES[:1]) + struct.pack("<IIII", 1, 1, 1 << 31, 1) + b"x" * 50
    assert len(list(captures.packet_rows(io.BytesIO(damaged)))) == 1
    for n in range(15):
        assert captures.decode(captures.Frame(0.0, 1, 60, bytes(n))).protocol == "ETHERNET"


def test_names_that_point_in_circles_or_off_the_end():
    head = struct.pack(">HHHHHH", 1, 0x8180, 1, 1, 0, 0)
    assert captures.dns_answers(head + b"\xc0\x0c\0\1\0\1") == ("", [])
    assert captures.dns_answers(head + b"\x05ab") == ("", [])
    assert captures.dns_answers(b"") == ("", []) and captures.dns_answers(struct.pack(">HHHHHH", 1, 0, 1, 0, 0, 0)) == ("", [])
    whole = hello("a.example.com")
    assert captures.server_name(whole) == "a.example.com"
    assert all(captures.server_name(whole[:n]) in ("", "a.example.com") for n in range(len(whole)))


def test_captures_equal_decoded_text(spark, tmp_path):
    folder = tmp_path / "c/plug/on2"
    folder.mkdir(parents=True)
    (folder / "one.pcap").write_bytes(FORMS["little"])
    (folder / "two.pcapng").write_bytes(FORMS["ng"])
    (folder / "empty.pcap").write_bytes(b"")
    (folder / "notes.txt").write_text("no capture")
    text = tmp_path / "t/plug/on2"
    text.mkdir(parents=True)
    names = [c.split()[0] for c in readers.RAW_PACKETS.split(", ")]
    lines = ["\t".join("" if v is None else str(v) for v in r) for r in captures.packet_rows(io.BytesIO(FORMS["big"]))]
    for f in ("one.txt", "two.txt"):
        (text / f).write_text("\t".join(names) + "\n" + "\n".join(lines) + "\n")
    got, want = captures.packets(spark, str(tmp_path / "c")), readers.packets(spark, str(tmp_path / "t"), raw=True)
    assert got.columns == want.columns
    plain = lambda df: sorted((tuple(x or None for x in r) for r in df.collect()), key=repr)
    assert plain(got) == plain(want) and got.count() == 2 * len(WANT)
    assert flows.without_retransmissions(flows.decodable(got)).count() == 2 * 7
    (tmp_path / "n/plug").mkdir(parents=True)
    (tmp_path / "n/plug/dns.pcap").write_bytes(FORMS["little"])
    history = captures.name_history(spark, "file://" + str(tmp_path / "n"))
    assert history.count() == 4
    told = lookups.as_of(got.where("frame_num = 2").selectExpr("device", "ip_dst as ip", "ts"), history, ["device", "ip"], "ts", "host")
    assert {(r["host"], r["outcome"]) for r in told.collect()} == {("api.example.com", "prior")}
    assert captures.packets(spark, str(tmp_path / "nothing")).collect() == []
