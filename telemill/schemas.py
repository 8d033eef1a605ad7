"""Table layouts (as DDL text) and fixed values shared by the operators."""

from __future__ import annotations

# --- fixed values: output column order of the canonical table ---
CANONICAL_COLUMNS = [
    "timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "client_id", "topic",
    "topicfilter", "qos", "retain", "dupflag", "payload_length", "Payload_sample",
    "packet_type", "protocol", "connack_code", "Label", "username", "msgid", "auth_reason",
]

# --- fixed values: header aliases per field, first present one wins ---
FIELD_ALIASES = {
    "timestamp": ["timestamp", "ts", "time", "frame.time_epoch", "frame.time_relative", "Time", "SniffTimestamp"],
    "src_ip": ["src_ip", "ip.src", "source_ip", "ipv4_src", "ip_source"],
    "dst_ip": ["dst_ip", "ip.dst", "destination_ip", "ipv4_dst", "ip_destination"],
    "src_port": ["src_port", "tcp.srcport", "source_port", "sport"],
    "dst_port": ["dst_port", "tcp.dstport", "destination_port", "dport"],
    "client_id": ["client_id", "clientid", "mqtt.clientid", "device_id", "deviceid", "client"],
    "topic": ["topic", "mqtt.topic", "Topic", "publish_topic"],
    "topicfilter": ["topicfilter", "mqtt.topicfilter", "subscription", "filter"],
    "qos": ["qos", "mqtt.qos", "request_qos", "mqtt.sub.qos", "mqtt.suback.qos"],
    "retain": ["retain", "retain_flag", "mqtt.retain", "mqtt.conflag.retain"],
    "dupflag": ["dupflag", "dup_flag", "mqtt.dupflag"],
    "payload_length": ["payload_length", "payload_len", "mqtt.msg_len", "mqtt.payload_len"],
    "packet_type": ["packet_type", "mqtt.msgtype", "msg_type", "message_type"],
    "protocol": ["protocol", "app_protocol", "mqtt.protoname", "proto_name"],
    "connack_code": ["connack_code", "mqtt.conack.val", "connack", "return_code"],
    "Label": ["Label", "label", "attack_type", "attack_label", "class"],
    "username": ["username", "mqtt.username", "user"],
    "msgid": ["msgid", "mqtt.msgid", "message_id"],
    "auth_reason": ["auth_reason", "reason", "disconnect_reason", "auth.reason"],
}

# --- fixed values: payload columns by priority for the sample, True = hex encoded ---
PAYLOAD_SAMPLE_PRIORITY = [
    ("payload_sample", False),
    ("payload", False),
    ("mqtt.msg", True),
    ("mqtt.willmsg", True),
    ("tcp.payload", True),
]

# --- fixed values: payload columns by priority for the length ---
PAYLOAD_LENGTH_PRIORITY = [
    ("mqtt.msg", "hex"),
    ("payload", "text"),
    ("payload_sample", "text"),
    ("tcp.payload", "hex"),
    ("mqtt.len", "number"),
]

# --- fixed values: MQTT control packet names for types 1..15 ---
PACKET_NAMES = [
    "CONNECT", "CONNACK", "PUBLISH", "PUBACK", "PUBREC", "PUBREL", "PUBCOMP", "SUBSCRIBE",
    "SUBACK", "UNSUBSCRIBE", "UNSUBACK", "PINGREQ", "PINGRESP", "DISCONNECT", "AUTH",
]

# --- fixed values: texts that mean "true" ---
TRUE_WORDS = ["true", "1", "yes", "y", "t"]

# --- fixed values: protocols kept by default ---
DEFAULT_PROTOCOLS = (
    "MQTT,MQTTS,MQTT-TLS,AMQP,AMQPS,COAP,COAPS,DDS,HTTP,HTTPS,MODBUS,MODBUS-TCP,BACNET,BACNET/IP,"
    "OPC-UA,OPCUA,ZIGBEE,Z-WAVE,ZWAVE,LORAWAN,NB-IOT,BLE,BLUETOOTH,BLUETOOTH-LE"
)

# --- fixed values: CSV cells that mean "missing" ---
MISSING_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: device types and the text fragments that identify them ---
DEVICE_PATTERNS = {
    "Temperature": ["temperature", "temp"],
    "Humidity": ["humidity", "humid"],
    "CO2": ["co2", "co-gas", "gas"],
    "Light": ["light", "lux", "intensity"],
    "Motion": ["motion", "movement", "pir"],
    "Smoke": ["smoke", "fire"],
    "Fan": ["fan", "speed"],
    "Door": ["door", "lock"],
    "Vibration": ["vibration", "vib"],
    "DistanceSensor": ["Distance"],
    "FlameSensor": ["Flame_Sensor"],
    "PhLevelSensor": ["PhLv"],
    "SoilMoisture": ["soil_moisture"],
    "SoundSensor": ["sound_sensors"],
    "WaterLevel": ["WaterLV"],
    "AirQuality": ["city/air"],
    "CoolerMotor": ["vibration/cooler"],
    "HydraulicSystem": ["hydraulic/rig"],
    "PredictiveMaintenance": ["maintenance/iotsim"],
}

TRAFFIC_LOG_SCHEMA = (
    "timestamp STRING, src_ip STRING, src_port STRING, dst_ip STRING, dst_port STRING, client_id STRING, "
    "topic STRING, qos INT, retain INT, dupflag INT, payload_length INT, payload_sample STRING, "
    "packet_type STRING, protocol STRING, msgid BIGINT, flow_stage STRING, label STRING"
)

MESSAGE_SCHEMA = (
    "topic STRING, payload BINARY, qos INT, retain BOOLEAN, ts TIMESTAMP"
)

FEATURES_SCHEMA = (
    "timestamp BIGINT, ts TIMESTAMP, client_id STRING, topic STRING, value STRING, value_num DOUBLE, "
    "payload_length INT, qos INT, retain_flag INT, dup_flag INT, msgid_present INT, iat_sec DOUBLE, "
    "Label STRING, seq BIGINT"
)

ALERT_COLUMNS = [
    "timestamp", "rule_name", "severity", "client_id", "topic", "description", "action", "blocked",
]

ALERTS_SCHEMA = (
    "timestamp STRING, rule_name STRING, severity STRING, client_id STRING, topic STRING, "
    "description STRING, action STRING, blocked BOOLEAN"
)

# --- fixed values: column layouts of the nine attack logs ---
ATTACK_LOG_SCHEMAS = {
    "flood": (
        "timestamp STRING, client_id STRING, src_ip STRING, topic STRING, packet_type STRING, "
        "payload_length INT, qos INT, mid BIGINT, result INT"),
    "wildcard": (
        "timestamp STRING, client_id STRING, packet_type STRING, topic STRING, payload STRING, details STRING"),
    "bruteforce": (
        "timestamp STRING, packet_type STRING, client_id STRING, src_ip STRING, topic STRING, "
        "connack_reason STRING, status STRING, latency_ms DOUBLE"),
    "payload_anomaly": (
        "timestamp_utc STRING, client_id STRING, topic STRING, anomaly_type STRING, payload_size INT, "
        "status STRING, error_msg STRING"),
    "retain_qos": (
        "timestamp_utc STRING, client_id STRING, topic STRING, attack_type STRING, qos INT, retain STRING, "
        "payload_size INT, status STRING, details STRING"),
    "topic_enumeration": (
        "timestamp_utc STRING, client_id STRING, topic STRING, action STRING, qos INT, status STRING, "
        "payload_preview STRING, details STRING"),
    "duplicate_id": (
        "timestamp_utc STRING, client_id STRING, action STRING, status STRING, return_code INT, "
        "session_present STRING, details STRING, conflict_detected STRING"),
    "reconnect": (
        "timestamp_utc STRING, client_id STRING, worker_id STRING, action STRING, status STRING, "
        "return_code INT, connection_time DOUBLE, session_duration DOUBLE, details STRING"),
    "qos2": (
        "timestamp_utc STRING, client_id STRING, worker_id STRING, message_id BIGINT, topic STRING, "
        "action STRING, qos INT, payload_size INT, handshake_step STRING, status STRING, details STRING"),
}

# --- fixed values: fields a log must carry, by a fragment of its name ---
REQUIRED_LOG_FIELDS = {
    "flood": {
        "timestamp": ["timestamp", "timestamp_utc"], "client_id": ["client_id"], "src_ip": ["src_ip"],
        "topic": ["topic"], "packet_type": ["packet_type"], "payload_length": ["payload_length"], "qos": ["qos"],
    },
    "wildcard": {
        "timestamp": ["timestamp", "timestamp_utc"], "client_id": ["client_id"],
        "packet_type": ["packet_type"], "topic": ["topic"],
    },
    "brute": {
        "timestamp": ["timestamp", "timestamp_utc"], "client_id": ["client_id"], "src_ip": ["src_ip"],
        "packet_type": ["packet_type"], "connack_reason": ["connack_reason"],
    },
}

# --- fixed values: the ten anomaly kinds of the payload log ---
ANOMALY_TYPES = [
    "oversized_payload", "malformed_json", "binary_data", "xml_injection", "sql_injection",
    "script_injection", "null_bytes", "unicode_overflow", "control_chars", "schema_violation",
]

# --- fixed values: camera message layouts ---
CAMERA_SCHEMAS = {
    "status": (
        "device_type STRING, camera_id STRING, zone STRING, timestamp STRING, status STRING, resolution STRING, "
        "fps INT, model STRING, ip_address STRING, firmware_version STRING, uptime_hours INT, temperature DOUBLE, "
        "cpu_usage DOUBLE, memory_usage DOUBLE, storage_used_gb DOUBLE, storage_total_gb INT, "
        "network_rx_mbps DOUBLE, network_tx_mbps DOUBLE, recording BOOLEAN, motion_detection_enabled BOOLEAN, "
        "night_vision_active BOOLEAN, ptz_position STRUCT<pan: INT, tilt: INT, zoom: INT>"),
    "motion": (
        "device_type STRING, event_type STRING, camera_id STRING, zone STRING, timestamp STRING, "
        "confidence DOUBLE, motion_area_percent DOUBLE, "
        "bounding_boxes ARRAY<STRUCT<x: INT, y: INT, width: INT, height: INT, confidence: DOUBLE>>, "
        "motion_vector STRUCT<direction: STRING, speed: STRING>, trigger_reason STRING, alert_level STRING"),
    "security": (
        "device_type STRING, event_type STRING, camera_id STRING, zone STRING, timestamp STRING, "
        "severity STRING, confidence DOUBLE, details MAP<STRING, STRING>, snapshot_id STRING, "
        "video_clip_id STRING, alert_sent BOOLEAN, requires_action BOOLEAN"),
    "system": (
        "device_type STRING, event_type STRING, camera_id STRING, zone STRING, timestamp STRING, source STRING, "
        "details MAP<STRING, STRING>, user_id STRING, requires_attention BOOLEAN"),
    "stream": (
        "device_type STRING, camera_id STRING, zone STRING, timestamp STRING, stream_status STRING, "
        "current_fps INT, current_resolution STRING, bitrate_kbps INT, frame_count BIGINT, dropped_frames INT, "
        "encoding STRING, audio_enabled BOOLEAN, storage_remaining_hours DOUBLE, quality_score DOUBLE"),
}

# --- fixed values: camera classes in the order they are tried ---
CAMERA_CLASSES = ["status", "motion", "stream", "security", "system"]

# --- fixed values: filters of the camera subscriber ---
CAMERA_FILTERS = [
    "surveillance/+/camera/+/status",
    "surveillance/+/camera/+/motion",
    "surveillance/+/camera/+/stream",
    "security/+/camera/+/event",
    "system/+/camera/+/event",
]
