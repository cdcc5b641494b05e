"""Builders of wire formats for tests."""

import struct


def pcap_of_units(units: list[list[bytes]]) -> bytes:
    """A capture of one RTP packet for each NAL unit."""
    out, seq = struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1), 65534
    for k, nals in enumerate(units):
        for i, nal in enumerate(nals):
            rtp = struct.pack(">BBHII", 0x80, 96 | (0x80 if i == len(nals) - 1 else 0), seq, 3000 * k, 9) + nal.ljust(2, b"\0")
            seq = (seq + 1) % 65536
            udp = struct.pack(">HHHH", 1, 5004, 8 + len(rtp), 0) + rtp
            p = b"\0" * 12 + b"\x08\0" + struct.pack(">BBHHHBBHII", 0x45, 0, 20 + len(udp), 0, 0, 64, 17, 0, 1, 2) + udp
            out += struct.pack("<IIII", k, 0, len(p), len(p)) + p
    return out
