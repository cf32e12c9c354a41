from .registry import REGISTRY, register

__all__ = ["REGISTRY", "register"]
