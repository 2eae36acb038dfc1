"""Rule tables. They must equal the published rules for results to agree; order is priority."""

# Extensions of each media bucket; the first bucket that holds an extension wins.
BUCKETS = {
    "photos": (".jpg", ".jpeg", ".png", ".heic", ".tif", ".tiff"),
    "raw": (".arw", ".dng", ".cr3", ".gpr", ".nef", ".raf", ".orf", ".rw2"),
    "videos": (".mp4", ".mov", ".avi", ".m4v", ".mxf", ".insv", ".lrv", ".mts", ".m2ts"),
    "sidecar": (".xmp", ".srt", ".lrf", ".thm", ".aae", ".xml", ".insp", ".lrtemplate", ".bdm", ".bin", ".int", ".prproj"),
}

# Stage rules.
GOPRO_NAME = r"^(gopr|gx|gh|gp|gs)[0-9]"
EDITED_NAME = r"-edit|_edit|edited|export|exported|final|graded|grade|retouch|select|pano|panorama|hdr|stitch|reframe|_lr|_ps"
EDITED_FOLDER = ("edited", "shortlist", "export", "prores", "final", "select")
STAGE_SIDECARS = (".xmp", ".srt", ".lrf", ".thm", ".aae", ".lrtemplate", ".lrv")

# What raw metadata must contain, any case.
ALTITUDE_MARK = "AbsoluteAltitude"
EDITING_SOFTWARE = ("Adobe Lightroom", "Adobe Photoshop", "Adobe ImageReady", "Topaz", "Capture One", "DaVinci", "Premiere", "Final Cut")
ROTATED_MARKS = ('"Orientation": 5', '"Orientation": 6', '"Orientation": 7', '"Orientation": 8', '"Orientation":5', '"Orientation":6', '"Orientation":7', '"Orientation":8')

# Trip rules: pattern (any case), label, category.
TRIP_RULES = (
    (r"costa\s*rica|gunacaste|guanacaste", "Costa Rica", "trips"),
    (r"french.?polynesia|borabora|bora\s*bora|tahiti|moorea", "French Polynesia", "trips"),
    (r"iceland|puffin|northern.?light", "Iceland", "trips"),
    (r"new.?zealand|^nz\b|milford", "New Zealand", "trips"),
    (r"christmas", "Christmas 2025", "trips"),
    (r"fall.?colors?", "Fall Colors 2025", "trips"),
    (r"\bbanff\b", "Banff", "trips"),
    (r"\bfrance\b|paris", "France 2025", "trips"),
    (r"grand.?cayman", "Grand Cayman", "trips"),
    (r"los.?angeles|\bla\b", "Los Angeles 2025", "trips"),
    (r"balloon|new.?mexico", "New Mexico Balloon Fest", "trips"),
    (r"niagara", "Niagara Falls", "trips"),
    (r"havasupai", "Havasupai", "trips"),
    (r"\butah\b", "Utah", "trips"),
    (r"arizona", "Arizona", "trips"),
    (r"olympic.?national", "Olympic National Park", "trips"),
    (r"whistler", "Whistler", "trips"),
    (r"high.?steel.?bridge", "High Steel Bridge", "trips"),
    (r"rainier", "Mount Rainier", "trips"),
    (r"\boregon\b", "Oregon", "trips"),
    (r"vancouver", "Vancouver", "trips"),
    (r"seattle", "Seattle", "trips"),
    (r"wedding", "Wedding", "events"),
    (r"engagement", "Engagement", "events"),
    (r"office.?mac|laptop.?items|vandini|iphone.?data|t9.?backup|current.?t9", "Personal Backups", "personal"),
    (r"sony.?dump|sony.?memory|samsungcard|lexar|apple.?prores|prores|sony.?\d|sony.?camera|may.?july.?25|card.?unload|\d{8}_\d{8}|sony\s*camera\s*15", "Camera Card Dumps", "camera-dumps"),
    (r"\bdrone\b", "Drone Footage", "camera-dumps"),
    (r"unorganized|unsorted|untitled|till\s*\d", "Unsorted", "unsorted"),
)

# Month of a trip whose files have no date.
TRIP_MONTHS = {
    "Costa Rica": "2024-04",
    "Iceland": "2024-09",
    "Wedding": "2024-06",
    "Engagement": "2023-10",
    "French Polynesia": "2025-01",
    "New Zealand": "2025-02",
    "Banff": "2025-06",
    "Los Angeles 2025": "2025-07",
    "France 2025": "2025-09",
    "Fall Colors 2025": "2025-10",
    "New Mexico Balloon Fest": "2025-10",
    "Christmas 2025": "2025-12",
    "Grand Cayman": "2024-08",
}

# Which drive's copy to keep; drives not listed come after.
DRIVE_PREFERENCE = {"T7 SSD2": 0, "T7 SSD1": 1, "Past T9": 2, "Current T9": 3}
OTHER_DRIVE = 9

# Gazetteer: place, latitude, longitude; a place counts within PLACE_KM.
PLACE_KM = 160.0
PLACES = (
    ("Reykjavík", 64.146, -21.942), ("Vík", 63.418, -19.006), ("San José CR", 9.928, -84.091), ("Liberia CR", 10.634, -85.437),
    ("Banff", 51.178, -115.571), ("Calgary", 51.045, -114.058), ("Jasper", 52.873, -118.081), ("Vancouver", 49.283, -123.121),
    ("Los Angeles", 34.052, -118.244), ("San Diego", 32.716, -117.161), ("San Francisco", 37.775, -122.419), ("San Jose", 37.339, -121.895),
    ("Las Vegas", 36.170, -115.140), ("Seattle", 47.606, -122.332), ("Portland", 45.515, -122.678), ("Phoenix", 33.448, -112.074),
    ("Albuquerque", 35.084, -106.651), ("Santa Fe", 35.687, -105.938), ("Denver", 39.739, -104.990), ("Salt Lake City", 40.760, -111.891),
    ("New York", 40.713, -74.006), ("Chicago", 41.878, -87.630), ("Miami", 25.762, -80.192), ("Austin", 30.267, -97.743),
    ("Honolulu", 21.307, -157.858), ("George Town KY", 19.286, -81.367), ("Cancún", 21.161, -86.851), ("Mexico City", 19.433, -99.133),
    ("Toronto", 43.651, -79.383), ("Yellowstone", 44.428, -110.588), ("Grand Canyon", 36.107, -112.113), ("Moab", 38.573, -109.550),
    ("Lima", -12.046, -77.043), ("Cusco", -13.532, -71.967), ("Rio de Janeiro", -22.907, -43.173), ("Buenos Aires", -34.604, -58.382),
    ("Santiago", -33.449, -70.669), ("Quito", -0.181, -78.468),
    ("London", 51.507, -0.128), ("Paris", 48.857, 2.352), ("Nice", 43.710, 7.262), ("Amsterdam", 52.370, 4.895),
    ("Rome", 41.903, 12.496), ("Venice", 45.440, 12.316), ("Barcelona", 41.385, 2.173), ("Madrid", 40.417, -3.703),
    ("Lisbon", 38.722, -9.139), ("Berlin", 52.520, 13.405), ("Zurich", 47.377, 8.542), ("Interlaken", 46.686, 7.863),
    ("Vienna", 48.208, 16.373), ("Prague", 50.076, 14.438), ("Santorini", 36.393, 25.461), ("Athens", 37.984, 23.728),
    ("Dubrovnik", 42.650, 18.091), ("Copenhagen", 55.676, 12.568), ("Oslo", 59.914, 10.752), ("Tromsø", 69.649, 18.956),
    ("Cape Town", -33.925, 18.424), ("Marrakesh", 31.630, -7.981), ("Cairo", 30.044, 31.236), ("Nairobi", -1.286, 36.817),
    ("Dubai", 25.205, 55.271), ("Istanbul", 41.008, 28.978),
    ("Tokyo", 35.690, 139.692), ("Kyoto", 35.012, 135.768), ("Bangkok", 13.756, 100.502), ("Singapore", 1.352, 103.820),
    ("Bali", -8.409, 115.189), ("Hong Kong", 22.320, 114.170), ("Seoul", 37.567, 126.978), ("Delhi", 28.614, 77.209),
    ("Mumbai", 19.076, 72.878), ("Kathmandu", 27.717, 85.324), ("Maldives", 3.202, 73.220),
    ("Papeete", -17.537, -149.566), ("Bora Bora", -16.501, -151.741), ("Moorea", -17.540, -149.830), ("Auckland", -36.848, 174.763),
    ("Queenstown NZ", -45.031, 168.663), ("Milford Sound", -44.671, 167.926), ("Sydney", -33.869, 151.209), ("Melbourne", -37.814, 144.963),
    ("Fiji", -18.124, 178.450),
)

# Words of a query that set a filter.
DEVICE_WORDS = {"drone": "Drone", "dji": "Drone", "aerial": "Drone", "gopro": "GoPro", "insta360": "Insta360", "insta": "Insta360", "iphone": "iPhone", "phone": "iPhone", "sony": "Sony", "camera": "Sony"}
ORIENTATION_WORDS = {"vertical": "Vertical", "portrait": "Vertical", "horizontal": "Horizontal", "landscape": "Horizontal"}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

# Content buckets by parts of labels.
BUCKET_KEYWORDS = {
    "Documents": ("document", "text", "paper", "receipt", "menu", "screenshot", "page", "book", "newspaper", "whiteboard", "sign"),
    "People": ("people", "person", "face", "portrait", "crowd", "group", "selfie", "baby", "wedding"),
    "Nature": ("mountain", "landscape", "beach", "ocean", "sea", "lake", "river", "forest", "tree", "sky", "cloud", "sunset", "sunrise", "waterfall", "snow", "desert", "field", "flower", "plant", "canyon", "valley"),
    "Wildlife": ("bird", "animal", "dog", "cat", "fish", "wildlife", "insect", "puffin", "whale", "deer", "horse"),
    "Cityscape": ("city", "building", "architecture", "street", "bridge", "skyline", "urban", "monument", "church", "tower"),
    "Food": ("food", "meal", "drink", "coffee", "restaurant", "dish", "fruit", "dessert", "plate"),
    "Vehicles": ("car", "boat", "airplane", "aircraft", "vehicle", "train", "motorcycle", "bicycle"),
}
SCREENSHOT_BUCKETS = ("documents", "document", "screenshot", "screenshots", "receipts")
SORTED_FOLDERS = ("/screenshots", "/documents", "/receipts")

# Words that say nothing.
CAPTION_STOP = ("img", "image", "photo", "dsc", "dji", "gopro", "screenshot", "the", "and", "of")
SEARCH_STOP = ("screenshot", "screenshots", "screen", "with", "the", "and", "for", "image", "images", "photo", "photos", "a", "of", "in", "on", "to")

# Staging.
PROXY_EXTENSIONS = (".thm", ".lrf", ".lrv", ".bin", ".int", ".bdm")
PAIRED_SIDECARS = (".xmp", ".aae", ".srt")
MANIFEST_COLUMNS = (
    "trip", "dest_name", "dest_subfolder", "device", "stage", "bucket", "orientation", "sidecar_of", "size_bytes", "sha256_inventory", "sha256_verified",
    "copy_status", "verify_status", "original_path", "resolved_source_path", "destination_path", "copied_at", "error",
)

# Thresholds and limits.
SHOT_PRIORITY = {".jpg": 0, ".jpeg": 0, ".heic": 0, ".png": 1, ".tif": 2, ".tiff": 2} | {e: 5 for e in BUCKETS["raw"]}
NEAR_DUPLICATE, SAME_FACE, MATCH_STRONG = 0.90, 0.82, 0.5
RELEVANCE = {"neural": 0.18, "lexical": 0.04}
EMBED_DIM = 512
GIB = 1 << 30
RETENTION_DAYS = 30

# Padding around a face, as a share of its box, and the least side of a crop in pixels.
FACE_PAD = 0.15
FACE_LEAST = 8
