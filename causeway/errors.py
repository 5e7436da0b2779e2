"""Errors with the codes that callers switch on."""

from __future__ import annotations


class EngineError(ValueError):
    code = "ENGINE_ERROR"

    def __init__(self, message: str, code: str | None = None):
        super().__init__(message)
        self.code = code or self.code


class RegistryError(EngineError):
    code = "INVALID_REGISTRY"


class StateError(EngineError):
    code = "INVALID_STATE"


class ExpansionError(EngineError):
    code = "EXPANSION_ERROR"


class DyadError(EngineError):
    code = "DYAD_ERROR"


class CausalError(EngineError):
    code = "CAUSAL_ERROR"


class CruxError(EngineError):
    code = "DELTA_U_ERROR"


class ClusterError(EngineError):
    code = "CLUSTERING_ERROR"


class ScenarioError(EngineError):
    code = "SIMULATION_ERROR"
