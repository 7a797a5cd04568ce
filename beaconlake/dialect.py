"""Identifiers of one producer family.

The envelope schema id, the recording format id and the names of the routing
and inference producers all follow from the namespace the producers use, so
the namespace is the single setting (``Dialect("vendor.product")``).
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    namespace: str = "beacon.telemetry"

    @property
    def vendor(self) -> str:
        return self.namespace.split(".")[0]

    @property
    def schema_id(self) -> str:
        return f"{self.namespace}.event/1"

    @property
    def recording_format(self) -> str:
        return f"{self.namespace}.recording/1"

    @property
    def runtime_producer(self) -> str:
        return f"{self.vendor}-runtime"

    @property
    def inference_producer(self) -> str:
        return f"{self.vendor}-inference"


DEFAULT = Dialect()
