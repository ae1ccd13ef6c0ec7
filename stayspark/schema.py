"""Column aliases, fixed schemas and fixed lookup values.

Everything under "FIXED VALUES" must equal the behaviour being matched
(labels, alias lists, keyword lists); it is kept as plain text, in natural
order, in one place.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the behaviour being reproduced; do not edit)
# ---------------------------------------------------------------------------

# Logical booking column -> accepted physical names, in priority order.
BOOKING_ALIASES: dict[str, list[str]] = {
    "id": ["R_ID", "id", "booking_id", "reservation_id"],
    "status": ["R_STATUS", "R_CONTA", "status", "estado"],
    "arrival": ["R_ARRIVAL", "arrival", "llegada", "check_in"],
    "departure": ["R_DEPARTURE", "departure", "salida", "check_out"],
    "nights": ["R_NIGHTS", "nights", "noches"],
    "amount": ["R_TOTAL_AMOUNT", "amount", "total", "importe", "precio"],
    "property": ["R_PROPERTY_NAME", "property", "propiedad", "alojamiento"],
    "source": ["R_SOURCE", "source", "canal", "channel"],
    "guest": ["R_GUEST_NAME", "guest", "huesped", "guest_name"],
    "owner": ["NAME", "name", "propietario", "owner"],
    "created": ["R_CREATED_AT", "created_at", "fecha_reserva"],
}

# Search planner column detection (exact names only, first present wins).
PLANNER_ALIASES: dict[str, list[str]] = {
    "property": ["R_PROPERTY_NAME", "property", "propiedad"],
    "date": ["FECHA", "R_ARRIVAL", "arrival", "llegada", "checkin", "check_in"],
    "nights": ["R_NIGHTS", "nights", "noches"],
    "status": ["R_STATUS", "R_CONTA", "status", "estado"],
}
PLANNER_VALID_STATUS = ["Booked", "Fact.", "Confirmada"]

STATUS_CONFIRMED = ["Booked", "Fact."]
STATUS_CANCELLED = ["Declined", "Annuled", "annuled", "Anulled", "Cancelled"]
STATUS_BLOCKED = ["Unavailable", "Cleaning"]
STATUS_OPEN = ["Open", "Tentative"]

MONTH_ES = ["Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio",
            "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre"]
MONTH_ES_SHORT = ["Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago",
                  "Sep", "Oct", "Nov", "Dic"]
# Monday first.
DOW_ES = ["Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo"]
SEASON_ORDER = ["Invierno", "Primavera", "Verano", "Otoño"]
# Season per month 1..12 (December-February is winter).
SEASON_BY_MONTH = ["Invierno", "Invierno", "Primavera", "Primavera", "Primavera",
                   "Verano", "Verano", "Verano", "Otoño", "Otoño", "Otoño", "Invierno"]

# Fixed-date holidays as MM-dd (18 April is a fixed "Good Friday").
HOLIDAYS_MM_DD = ["01-01", "01-06", "03-19", "04-18", "05-01", "08-15",
                  "10-12", "11-01", "12-06", "12-08", "12-25"]

# Channel patterns, first match wins.
CHANNEL_PATTERNS: list[tuple[str, str]] = [
    ("(?i)booking", "Booking.com"),
    ("(?i)airbnb", "Airbnb"),
    ("(?i)homeaway|vrbo", "HomeAway/VRBO"),
    ("(?i)^oh$", "Other Holiday"),
    ("(?i)manual|caty|maria", "Manual / Directo"),
    ("(?i)limp", "Limpieza/Bloqueo"),
]
CHANNEL_BLANK = ["", "nan", "<NULL>"]
CHANNEL_NONE = "Directo / Sin canal"
CHANNEL_UNKNOWN = "Desconocido"

CHANNEL_COMMISSION = {"Booking.com": 0.15, "Airbnb": 0.14, "HomeAway/VRBO": 0.12}

DAYS_PER_MONTH = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
DAYS_PER_QUARTER = {"Q1": 90, "Q2": 91, "Q3": 92, "Q4": 92}

# Bookings date formats tried column-wide, in order (Spark patterns for
# %d/%m/%Y, %Y-%m-%d, %d-%m-%Y, %m/%d/%Y, %d/%m/%Y %H:%M:%S).
DATE_FORMATS = ["d/M/yyyy", "yyyy-M-d", "d-M-yyyy", "M/d/yyyy", "d/M/yyyy H:m:s"]
# Planner row-level formats (%d/%m/%Y, %Y-%m-%d, %d-%m-%Y).
PLANNER_DATE_FORMATS = ["d/M/yyyy", "yyyy-M-d", "d-M-yyyy"]

# Property name keyword -> market city, first match in this order wins.
CITY_KEYWORDS: list[tuple[str, str]] = [
    ("valdelinares", "Valdelinares"),
    ("oropesa", "Oropesa del Mar"),
    ("marina del cid", "Castellón de la Plana"),
    ("castellon", "Castellón de la Plana"),
    ("castellón", "Castellón de la Plana"),
    ("valencia", "Valencia"),
    ("madrid", "Madrid"),
    ("barcelona", "Barcelona"),
    ("benidorm", "Benidorm"),
    ("alicante", "Alicante"),
    ("torrevieja", "Torrevieja"),
    ("gandia", "Gandía"),
    ("peñiscola", "Peñíscola"),
    ("peniscola", "Peñíscola"),
]

# Listing card extraction.
GENERIC_TITLE_WORDS = ["apartamento en", "casa en", "estudio en", "habitación en",
                       "loft en", "villa en", "vivienda en", "alojamiento en"]
CARD_NOISE_WORDS = ["superanfitrión", "nuevo", "★", "evaluaciones", "reseñas",
                    "profesional", "anfitrión", "dormitorio", "cama", "baño",
                    "noche", "total"]
LODGING_TYPES = ["Apartamento entero", "Habitación privada", "Habitación compartida",
                 "Casa entera", "Cabaña", "Apartamento en"]
LISTING_SITE_ROOT = "https://www.airbnb.es"
NO_TITLE = "Sin nombre"
UNKNOWN_TYPE = "Desconocido"
# Card containers and robot check markers on captured pages.
CARD_MARKERS = ['data-testid="card-container"', 'itemprop="itemListElement"',
                'data-testid="listing-card-wrapper"']
# Attributes of a card's title and price row, first match wins.
CARD_TITLE_ATTRIBUTES = ['id="title_', 'data-testid="listing-card-title"', 'data-testid="listing-card-name"']
CARD_PRICE_ATTRIBUTES = ['data-testid="price-availability-row"', r'class="[^"]*\b_1jo4hgw\b', 'class="[^"]*pricingText']
LISTING_PAGE_MARKERS = ['[data-testid="card-container"]', "itemListElement"]
ROBOT_MARKERS = ["captcha", "are you a robot"]

ELASTICITY_LABELS = [
    "Demanda inelástica — puedes subir precios sin perder muchas reservas.",
    "Elasticidad moderada — incrementos de precio moderados son sostenibles.",
    "Demanda elástica — los clientes son sensibles al precio, sube gradualmente.",
]
OPPORTUNITY_LABELS = {
    "Pico": "🔴 Subir precio YA (+20-25 %)",
    "Alto": "🟡 Subir precio moderado (+8-12 %)",
    "Normal": "🟢 Mantener precio",
    "Valle": "🔵 Ofrecer early-bird (-8 %)",
}
DEMAND_TIERS = [("Pico", 0.80, 1.22), ("Alto", 0.60, 1.10), ("Normal", 0.40, 1.0)]
LOW_TIER = ("Valle", 0.92)

DIAGNOSIS_TEXT = {
    "adr_high": "ADR Superior: Su precio por noche ({ppn}€) es un {pct}% superior a la media.",
    "rotation": "Alta Rotación: Tiene un volumen de reservas superior al promedio de la cartera.",
    "diversified": "Diversificación de Canales: No depende críticamente de una sola fuente de ingresos.",
    "adr_low": "ADR Bajo: El precio por noche está por debajo de la media global ({gppn}€).",
    "volatile": "Alta Volatilidad Estacional: Los ingresos fluctúan drásticamente entre meses.",
    "dependent": "Riesgo de Dependencia: El {share}% de reservas vienen de {channel}.",
    "no_pros": "Rendimiento estable.",
    "no_cons": "No se detectan riesgos críticos.",
}

MARKET_SEASONS = {"alta": [7, 8], "media": [5, 6, 9], "baja": [10, 11, 12, 1, 2, 3, 4]}

# Recommendation texts (title, template); {top3}, {bot3}, {ppn}, {pct},
# {media}, {gold} are filled per property.
RECOMMENDATIONS = {
    "raise": ("🚀 Subida de Precios",
              "En los meses de {top3} tienes la mayor demanda. "
              "Sube el precio un 10-15% para maximizar el RevPAR sin perder ocupación."),
    "low_season": ("🎯 Oferta de Temporada Baja",
                   "Los meses de {bot3} son tus valles de demanda. "
                   "Crea paquetes de 'Escapada Express' con descuento del 10% "
                   "o elimina la estancia mínima para capturar reservas de último minuto."),
    "price_up": ("💰 Ajuste de Precio",
                 "Tu precio medio (€{ppn}) está un {pct}% "
                 "por debajo de la media de la cartera (€{media}). "
                 "Considera subir gradualmente el precio base un 5%."),
    "price_review": ("⚖️ Revisión de Precio",
                     "Tu precio está un {pct}% por encima de la media. "
                     "Asegúrate de que las reseñas y los servicios justifiquen la diferencia."),
    "reviews": ("⭐ Gestión de Reseñas",
                "Responde a todas las reseñas en menos de 24h. "
                "Un aumento de 0.1 en la puntuación media puede incrementar "
                "los ingresos hasta un 5% según estudios del sector."),
    "min_stay": ("📅 Mínimo de Estancia",
                 "Tu mes de oro es {gold}. Durante ese mes, "
                 "establece una estancia mínima de 3-5 noches para maximizar la eficiencia operativa "
                 "y reducir costes de rotación."),
}
GROWTH_RATE = 0.12
OCCUPANCY_UPLIFT = 1.07
PEER_PREFIX = "⭐ "

# ---------------------------------------------------------------------------
# Fixed schemas
# ---------------------------------------------------------------------------

MARKET_SCHEMA = T.StructType([
    T.StructField("nombre", T.StringType()),
    T.StructField("precio_noche", T.IntegerType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("num_reviews", T.IntegerType()),
    T.StructField("tipo", T.StringType()),
    T.StructField("capacidad", T.IntegerType()),
    T.StructField("url", T.StringType()),
    T.StructField("fecha_scraping", T.DateType()),
    T.StructField("checkin", T.DateType()),
    T.StructField("checkout", T.DateType()),
    T.StructField("ciudad", T.StringType()),
    T.StructField("propiedad_referencia", T.StringType()),
])
MARKET_COLUMNS = [f.name for f in MARKET_SCHEMA.fields]

CARD_COLUMNS = ["title_raw", "price_raw", "text", "href", "checkin", "checkout",
                "ciudad", "propiedad_referencia", "scraped_on"]
