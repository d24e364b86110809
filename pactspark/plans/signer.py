"""Signatures under envelopes from a signer at the other end of a socket.

The engine holds no key. One connection serves one envelope, with a line of JSON
each way: the envelope out, ``{"jws": ...}`` or ``{"error": ...}`` back.
"""

from __future__ import annotations

import json
import socket
import time
from collections.abc import Callable, Mapping

#: The longest answer in bytes, the seconds that one envelope may take.
MOST_BYTES, SECONDS = 1 << 20, 10.0


class SigningError(RuntimeError):
    """No signature: the answer is withheld."""


class SocketSigner:
    """``connect`` opens a stream socket within the seconds it is given."""

    def __init__(self, connect: Callable[[float], socket.socket], seconds: float = SECONDS):
        self.connect, self.seconds = connect, seconds

    @classmethod
    def tcp(cls, host: str, port: int, seconds: float = SECONDS) -> SocketSigner:
        return cls(lambda left: socket.create_connection((host, port), timeout=left), seconds)

    @classmethod
    def unix(cls, path: str, seconds: float = SECONDS) -> SocketSigner:
        def connect(left: float) -> socket.socket:
            end = socket.socket(socket.AF_UNIX)
            end.settimeout(left)
            try:
                end.connect(path)
            except OSError:
                end.close()
                raise
            return end

        return cls(connect, seconds)

    def sign(self, envelope: Mapping) -> str:
        """The compact signature of ``envelope``; SigningError where there is none in time."""
        until = time.monotonic() + self.seconds
        left = lambda: max(until - time.monotonic(), 1e-3)
        held = b""
        try:
            with self.connect(left()) as end:
                end.settimeout(left())
                end.sendall(json.dumps(envelope, default=str).encode() + b"\n")
                while b"\n" not in held and len(held) < MOST_BYTES and time.monotonic() < until:
                    end.settimeout(left())
                    if not (more := end.recv(min(65536, MOST_BYTES - len(held)))):
                        break
                    held += more
        except TimeoutError as e:
            raise SigningError(f"no answer from the signer within {self.seconds:g} s") from e
        except OSError as e:
            raise SigningError(f"the signer can't be reached: {e}") from e
        line, ended, _ = held.partition(b"\n")
        if not ended:
            raise SigningError(f"no whole answer from the signer within {self.seconds:g} s and {MOST_BYTES} bytes")
        try:
            answer = json.loads(line)
        except ValueError as e:
            raise SigningError("the signer's answer is no JSON") from e
        jws = answer.get("jws") if isinstance(answer, dict) and answer.get("error") is None else None
        if not isinstance(jws, str) or not jws:
            raise SigningError(f"the signer gave no signature: {answer.get('error') if isinstance(answer, dict) else answer}")
        return jws
