"""A session that stays open behind a local socket: serve, ask, status and stop.

One request and one answer, each a line of JSON, per connection; requests are handled one after the other. A request names
a command and its arguments; the answer is the command's envelope. Results of queries are kept by the vault until the
index changes.

    python -m quillspark.daemon serve --vault /srv/vault --socket /run/vault.sock
    python -m quillspark.daemon query --socket /run/vault.sock --from docs --query "project map"
    python -m quillspark.daemon status|stop --socket /run/vault.sock
"""

from __future__ import annotations

import argparse
import contextlib
import json
import os
import socket
import sys
import time
from collections.abc import Callable

from quillspark import api
from quillspark.config import resolve

MAX_REQUEST = 1 << 20


class DaemonError(RuntimeError):
    pass


def commands(vault: api.Vault) -> dict[str, Callable]:
    """What a request may name: reads, and writes where the configuration allows them."""
    return {
        "query": lambda **a: vault.query(a.pop("from"), **a),
        "stats": lambda **a: vault.stats(**a),
        "health": lambda **a: vault.health(**a),
        "preflight": lambda **a: vault.preflight(**a),
        "reconcile": lambda **a: vault.reconcile(**a),
        "doc.read": lambda **a: vault.doc_read(**a),
        "doc.write": lambda **a: vault.doc_write(**a),
        "base.list": lambda **a: vault.base_list(**a),
    }


def _line(connection: socket.socket) -> bytes:
    data = b""
    while not data.endswith(b"\n"):
        part = connection.recv(65536)
        if not part:
            break
        data += part
        if len(data) > MAX_REQUEST:
            raise DaemonError("request is too long")
    return data


def serve(vault: api.Vault, path: str) -> dict:
    """Answer requests until one asks to stop. A socket that nobody listens to any more is taken over; one that is in use is
    an error. Returns how many requests were answered."""
    if os.path.exists(path):
        if status(path)["running"]:
            raise DaemonError(f"already served: {path}")
        os.unlink(path)
    began, n, known = time.time(), 0, commands(vault)
    with socket.socket(socket.AF_UNIX, socket.SOCK_STREAM) as server:
        server.bind(path)
        os.chmod(path, 0o600)
        server.listen(16)
        try:
            while True:
                connection, _ = server.accept()
                with connection:
                    name = ""
                    try:
                        request = json.loads(_line(connection))
                        name = request.get("command", "")
                        if name == "stop":
                            answer = api.envelope("daemon.stop", {"stopped": True}, time.time())
                        elif name == "status":
                            answer = api.envelope("daemon.status", {"running": True, "pid": os.getpid(), "uptime": round(time.time() - began, 3), "requests": n, "version": vault.store.version() if vault.store else None}, time.time())
                        elif name in known:
                            answer = api.command(name)(known[name])(**request.get("args", {}))
                            n += 1
                        else:
                            raise api.CommandError("invalid_argument", f"unknown command '{name}'")
                    except Exception as e:  # noqa: BLE001 - a bad request must not end the server
                        answer = api.envelope(name or "daemon", None, time.time(), error=api.classify(e))
                    with contextlib.suppress(OSError):  # the client may have gone
                        connection.sendall(json.dumps(answer, ensure_ascii=False, default=str).encode() + b"\n")
                if name == "stop":
                    return {"requests": n}
        finally:
            with contextlib.suppress(OSError):
                os.unlink(path)


def ask(path: str, command: str, timeout: float = 600, /, **args: object) -> dict:
    """Send a request and return the answer."""
    with socket.socket(socket.AF_UNIX, socket.SOCK_STREAM) as client:
        client.settimeout(timeout)
        try:
            client.connect(path)
        except OSError as e:
            raise DaemonError(f"nothing is served at {path}") from e
        client.sendall(json.dumps({"command": command, "args": args}, ensure_ascii=False).encode() + b"\n")
        data = b""
        while part := client.recv(65536):
            data += part
    if not data:
        raise DaemonError("the server closed the connection")
    return json.loads(data)


def status(path: str) -> dict:
    try:
        return ask(path, "status", 10)["data"]
    except (DaemonError, OSError, ValueError):
        return {"running": False}


def stop(path: str) -> bool:
    """Stop the server; False if none was there."""
    try:
        return bool(ask(path, "stop", 60)["data"]["stopped"])
    except DaemonError:
        return False


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillspark.daemon")
    parser.add_argument("action", choices=["serve", "status", "stop", "query"])
    parser.add_argument("--socket", required=True)
    parser.add_argument("--vault")
    parser.add_argument("--from", dest="from_", default="docs")
    for name in ("query", "where", "sort", "select", "path", "view-name"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--limit", type=int, default=100)
    a = parser.parse_args(argv)
    if a.action == "serve":
        from quillspark.runtime import build_session

        vault = api.Vault.open(build_session(), resolve({"vault_root": a.vault} if a.vault else {}))
        print(json.dumps(serve(vault, a.socket)))
        return 0
    if a.action == "status":
        print(json.dumps(status(a.socket)))
        return 0
    if a.action == "stop":
        return 0 if stop(a.socket) else 1
    args = {k: getattr(a, k) for k in ("query", "where", "sort", "select", "path", "view_name") if getattr(a, k) is not None}
    answer = ask(a.socket, "query", **{"from": a.from_}, limit=a.limit, **args)
    print(json.dumps(answer, ensure_ascii=False))
    return 0 if answer["ok"] else 1


if __name__ == "__main__":
    sys.exit(main())
