"""Canonical accident schema and the fixed vocabularies."""

from __future__ import annotations

ACCIDENT_DDL = """
 accident_id STRING, date DATE, time STRING, latitude DOUBLE, longitude DOUBLE,
 weather STRING, road_type STRING, speed_limit INT, num_vehicles INT,
 num_casualties INT, light_conditions STRING, road_surface STRING,
 junction_type STRING, severity STRING
"""

# ---- fixed values: they decide results and are part of the interface --------

# Header spellings accepted for each canonical column, in order of preference.
COLUMN_ALIASES = [
    ("lat", "latitude"),
    ("lng", "longitude"),
    ("lon", "longitude"),
    ("accident_severity", "severity"),
    ("severity_level", "severity"),
    ("weather_condition", "weather"),
    ("weather_conditions", "weather"),
    ("road_condition", "road_surface"),
    ("surface_condition", "road_surface"),
    ("number_of_vehicles", "num_vehicles"),
    ("vehicles", "num_vehicles"),
    ("number_of_casualties", "num_casualties"),
    ("casualties", "num_casualties"),
    ("light_condition", "light_conditions"),
    ("lighting", "light_conditions"),
    ("junction", "junction_type"),
    ("junction_detail", "junction_type"),
    ("accident_date", "date"),
    ("crash_date", "date"),
    ("accident_time", "time"),
    ("crash_time", "time"),
    ("speed", "speed_limit"),
    ("limit", "speed_limit"),
]

SEVERITY_WORDS = {
    "Minor": ["1", "slight", "minor", "low"],
    "Serious": ["2", "serious", "moderate", "medium"],
    "Fatal": ["3", "fatal", "severe", "high", "killed"],
}
WEATHER_WORDS = {
    "Clear": ["fine", "clear", "dry", "sunny"],
    "Rain": ["rain", "raining", "wet", "rainy"],
    "Fog": ["fog", "foggy", "mist", "haze"],
    "Snow": ["snow", "snowing", "icy", "ice"],
}
ROAD_WORDS = {
    "Urban": ["urban", "city", "town"],
    "Rural": ["rural", "country", "village"],
    "Motorway": ["highway", "motorway", "expressway", "freeway", "national_highway"],
}

SEVERITIES = ["Minor", "Serious", "Fatal"]
SEVERITY_CODES = {"Minor": 0, "Serious": 1, "Fatal": 2}
SEVERITY_POINTS = {"Minor": 20, "Serious": 60, "Fatal": 100}
SEVERITY_POINTS_OTHER = 30
SEVERITY_WEIGHTS = {"Minor": 1, "Serious": 3, "Fatal": 5}
WEATHER_POINTS = {"Clear": 0, "Rain": 10, "Fog": 15, "Snow": 20}
WEATHER_POINTS_OTHER = 5

# Risk factors in tenths, so that products stay exact integers.
ROAD_TENTHS = ({"Urban": 10, "Rural": 12, "Motorway": 15}, 10)
LIGHT_TENTHS = ({"Daylight": 10, "Dark": 15}, 12)
SURFACE_TENTHS = ({"Dry": 10, "Wet": 13, "Ice": 18}, 12)

FACTOR_COLUMNS = [
    "weather", "road_type", "light_conditions", "road_surface", "junction_type", "time_of_day",
]
LABEL_COLUMNS = ["weather", "road_type", "light_conditions", "road_surface", "junction_type"]
RUSH_HOURS = [7, 8, 9, 16, 17, 18]

MARKER_COLOURS = {"Minor": "#34A853", "Serious": "#FBBC05", "Fatal": "#EA4335"}
MARKER_COLOUR_OTHER = "#4285F4"

INCIDENT_TYPES = {
    0: "Unknown", 1: "Accident", 2: "Fog", 3: "Dangerous Conditions", 4: "Rain", 5: "Ice",
    6: "Jam", 7: "Lane Closed", 8: "Road Closed", 9: "Road Works", 10: "Wind", 11: "Flooding",
    14: "Broken Down Vehicle",
}

CITIES = [
    ("New York", 40.7128, -74.0060),
    ("Los Angeles", 34.0522, -118.2437),
    ("Chicago", 41.8781, -87.6298),
    ("Houston", 29.7604, -95.3698),
    ("Phoenix", 33.4484, -112.0740),
    ("London", 51.5074, -0.1278),
    ("Paris", 48.8566, 2.3522),
    ("Berlin", 52.5200, 13.4050),
    ("Tokyo", 35.6762, 139.6503),
    ("Sydney", -33.8688, 151.2093),
    ("Mumbai", 19.0760, 72.8777),
    ("Delhi", 28.6139, 77.2090),
    ("Singapore", 1.3521, 103.8198),
    ("Dubai", 25.2048, 55.2708),
    ("Toronto", 43.6532, -79.3832),
    ("San Francisco", 37.7749, -122.4194),
    ("Seattle", 47.6062, -122.3321),
    ("Boston", 42.3601, -71.0589),
    ("Miami", 25.7617, -80.1918),
    ("Atlanta", 33.7490, -84.3880),
]

# Named places for the map caption: first match wins, half-width in degrees.
KNOWN_LOCATIONS = [
    ("Delhi, India", 28.6139, 77.2090, 0.5),
    ("Mumbai, India", 19.0760, 72.8777, 0.5),
    ("London, UK", 51.5074, -0.1278, 0.5),
    ("New York, USA", 40.7128, -74.0060, 0.5),
]

# name, description, severity / casualty / fatal reduction
INTERVENTIONS = [
    ("speed_reduction", "Reduce speed limits by 10 km/h in high-risk zones", 0.25, 0.30, 0.40),
    ("improved_lighting", "Install improved street lighting", 0.15, 0.15, 0.20),
    ("junction_redesign", "Redesign dangerous junctions with roundabouts", 0.35, 0.25, 0.50),
    ("weather_warning_system", "Install real-time weather warning systems", 0.10, 0.12, 0.15),
    ("comprehensive", "Implement all recommended interventions", 0.50, 0.45, 0.60),
]

FEATURE_TEXT = {
    "speed_limit": "Higher speed limits are associated with more severe accidents",
    "num_vehicles": "Multi-vehicle accidents tend to be more serious",
    "num_casualties": "More casualties indicate higher accident severity",
    "weather_encoded": "Weather conditions significantly affect accident risk",
    "road_type_encoded": "Road type (urban vs rural vs motorway) impacts safety",
    "light_conditions_encoded": "Poor lighting increases accident severity",
    "road_surface_encoded": "Wet or icy roads increase danger",
    "junction_type_encoded": "Complex junctions are more dangerous",
}

# Bands: (bound, label); the last label has no bound.
RISK_BANDS = ([(25, "Low"), (50, "Medium"), (75, "High")], "Critical")                       # below
CITY_BANDS = ([(33, "Low"), (66, "Medium")], "High")                                         # below
CITY_COLOURS = ([(33, "green"), (66, "orange")], "red")                                      # below
DELAY_BANDS = ([(4, "Critical"), (3, "Major"), (2, "Moderate"), (1, "Minor")], "Low")        # from
CONGESTION_BANDS = ([(70, "Critical"), (50, "High"), (30, "Moderate")], "Low")               # from
CONGESTION_COLOURS = ([(70, "#ff0040"), (50, "#ff6600"), (30, "#ffcc00")], "#00ff88")        # from
# Confidence in a model: level, colour, text.
CONFIDENCE = (
    ("High", "#34A853", "Model predictions are highly reliable"),
    ("Medium", "#FBBC05", "Model predictions are reasonably reliable"),
    ("Low", "#EA4335", "More data needed for reliable predictions"),
)

# Feed severities as accident severities, and the casualties assumed for each.
FEED_SEVERITIES = {"Critical": "Fatal", "Major": "Serious", "Moderate": "Serious", "Minor": "Minor", "Low": "Minor"}
FEED_CASUALTIES = {"Fatal": 2, "Serious": 1, "Minor": 0}

# Road-design rules: category -> priority, recommendation, expected impact.
DESIGN_TEXTS = {
    "Junction Design": (
        "High",
        "Consider installing traffic signals, improving visibility, or adding dedicated turn lanes at these junction types.",
        "Potential 20-30% reduction in junction-related accidents",
    ),
    "Road Surface": (
        "High",
        "Improve drainage systems, apply anti-skid treatments, and install weather warning signs.",
        "Potential 15-25% reduction in weather-related accidents",
    ),
    "Lighting Infrastructure": (
        "Medium",
        "Enhance street lighting, install reflective road markings, and add LED road studs.",
        "Potential 10-20% reduction in night-time accidents",
    ),
    "Speed Management": (
        "High",
        "Implement variable speed limits, install speed cameras, and add traffic calming measures.",
        "Potential 25-35% reduction in severe accidents on high-speed roads",
    ),
    "Weather Warning Systems": (
        "Medium",
        "Install fog detection sensors, variable message signs, and automatic speed reduction systems.",
        "Potential 20-30% reduction in fog-related accidents",
    ),
    "Traffic Flow Management": (
        "Medium",
        "Implement intelligent traffic signals, create dedicated bus lanes, and improve intersection timing.",
        "Potential 15-20% reduction in rush hour accidents",
    ),
}

# Priority rules: category -> impact, priority, recommendation, action, estimated reduction, cost.
# Speed Control's impact and priority depend on fatal accidents; {n} is the number of hotspots.
PRIORITY_TEXTS = {
    "Speed Control": (
        None, None, "Reduce speed limits in high-accident zones",
        "Install speed cameras and reduce limits to 50 km/h", "25-40% fewer severe accidents", "Medium",
    ),
    "Junction Redesign": (
        85, "High", "Convert dangerous intersections to roundabouts",
        "Prioritize junctions with 5+ accidents for redesign", "35-50% fewer junction accidents", "High",
    ),
    "Lighting Improvement": (
        70, "Medium", "Install LED street lighting in dark zones",
        "Focus on areas with nighttime accident clusters", "15-20% fewer night accidents", "Medium",
    ),
    "Road Surface": (
        65, "Medium", "Improve drainage and install anti-skid surfaces",
        "Target roads with frequent wet-condition accidents", "15-25% fewer weather-related accidents", "High",
    ),
    "Visibility Enhancement": (
        55, "Medium", "Install fog warning systems and reflective markers",
        "Deploy automatic fog detection on prone routes", "10-20% fewer fog-related accidents", "Low",
    ),
    "Traffic Calming": (
        80, "High", "Deploy traffic calming measures at {n} identified hotspots",
        "Install speed bumps, chicanes, and pedestrian islands", "20-30% fewer accidents in hotspot areas", "Medium",
    ),
    "Signage Improvement": (
        45, "Low", "Upgrade warning signs and road markings",
        "Install larger, reflective signs at high-risk locations", "5-10% improvement in driver awareness", "Low",
    ),
}
