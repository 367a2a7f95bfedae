from docloom.functions import encoding, labels, text

__all__ = ["encoding", "labels", "text"]
