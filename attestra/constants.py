"""Fixed values of the verification rules; results depend on each of them."""

#: Duplicate radius in pixels (strict) and symbols kept for a page.
DUPLICATE_RADIUS, SYMBOLS_PER_PAGE = 20.0, 64
#: Shape clusters: least similarity, glyph height ratio, purity and votes.
SIMILARITY, SIZE_LOW, SIZE_HIGH, PURITY, VOTES = 0.92, 0.80, 1.25, 0.80, 2
#: Least score of a text reading, and largest skew in degrees.
MIN_SCORE, MAX_SKEW = 0.80, 5.0
#: Template reading: margin to the second, similarity, fit of a font, gap between fonts.
TEMPLATE_MARGIN, TEMPLATE_SIMILARITY, TEMPLATE_FIT, FONT_GAP = 0.02, 0.70, 0.83, 0.01
#: Line classes: relative height of small letters, depth of descenders, tolerance of a candidate's height.
SMALL, DESCENT, HEIGHT_TOLERANCE = 0.85, 0.12, 0.15
#: Glyph descriptor edge, height of recognition input, its width range, least raster width.
DESCRIPTOR_EDGE, READ_HEIGHT, READ_WIDTHS, RASTER_WIDTH = 24, 48, (16, 1600), 1600
#: Text areas: below (side, gap, height) and to the right (length, gap, above, below), in widths and thicknesses.
BELOW_SIDE, BELOW_GAP, BELOW_HEIGHT = 1.5, 0.05, 1.15
RIGHT_LENGTH, RIGHT_GAP, RIGHT_ABOVE, RIGHT_BELOW = 8, 0.05, 0.05, 0.25
#: Label frames: strictly wider and higher than so many points.
FRAME_WIDTH, FRAME_HEIGHT = 120, 60
#: Resolutions of the two readings.
DPI, DPI_HIGH = 400, 800
#: Placement of printed values: scales tried, share of ink that counts as blank, cost of area off the page.
PLACE_SCALES, PLACE_BLANK, PLACE_OUTSIDE = (1.0, 0.8, 0.65, 0.5, 0.4, 0.3), 0.003, 0.5
#: Fonts of the templates, and candidate characters without and with small letters.
FONTS = ("Arial", "Calibri")
CAPITALS, LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbologies of two dimensions, with letters only.
MATRIX_CODES = ("datamatrix", "qrcode", "microqrcode", "rmqrcode", "aztec", "maxicode")
