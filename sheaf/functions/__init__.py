"""Functions: scalars as Columns, codecs, crypto, fonts, colour, images, numeric functions."""
