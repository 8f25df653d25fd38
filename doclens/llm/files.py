"""Files in shared folders; see :mod:`doclens.files`."""

from doclens.files import Whole, make_folder, opened, read_range

__all__ = ["Whole", "make_folder", "opened", "read_range"]
