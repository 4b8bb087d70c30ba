"""Training-data operators over `documents`. Nothing else in the library imports this subpackage."""
